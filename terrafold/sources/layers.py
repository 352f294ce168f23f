"""Lookups, scenario tables, grids and polygon layers in; grids and summaries out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import finite

SCENARIO = "crop string, practice string, n_years string, irr_fp string, red_till string, save_co2 string"
SUMMARY = ["region", "practice", "metric", "value", "unit", "notes"]


@dataclass(frozen=True)
class Grid:
    """What a grid's cells are numbered by: reference system, north-west corner, steps, size and nodata value.

    Sizes of None are not known; a layer's own record, written with it, always has them.
    """

    x0: float
    y0: float
    dx: float
    dy: float
    ncols: int | None = None
    nrows: int | None = None
    crs: str = "EPSG:4326"
    nodata: float | None = None

    def same(self, other: Grid) -> None:
        """Raise unless both grids have one reference system, corner, step and size, within a thousandth of a step."""
        for k in ("crs", "x0", "y0", "dx", "dy", "ncols", "nrows"):
            a, b = getattr(self, k), getattr(other, k)
            near = abs(a - b) <= self.dx / 1000 if k in ("x0", "y0") else abs(a - b) * (self.ncols or 1) <= self.dx / 1000 if k in ("dx", "dy") else a == b
            if not near:
                raise ValueError(f"layers must match raster dimensions: {k} is {a!r} and {b!r}")


GRID_RECORD = "x0 double, y0 double, dx double, dy double, ncols int, nrows int, crs string, nodata double"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; on a single machine without one, in a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    if blocks := _open.get():
        blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths that ``materialized`` wrote inside each open ``temporary`` block of this thread.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("layers_open", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialized`` writes inside are deleted on leaving; the result has to be written or read before."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        delete(spark, *paths)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders or files in whatever store they lie."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end: the commit marker is there, not just the folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def lookup_csv(spark: SparkSession, path: str, schema: str, description: str, sep: str = ",") -> DataFrame:
    """A CSV lookup with a header; a missing file raises FileNotFoundError that names table and path.

    Columns of another order or name than the schema's raise when the file is read; a byte-order mark does not matter.
    """
    try:
        return spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("enforceSchema", False).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{description} not found at {path}") from e
        raise


def days_in_month(years: DataFrame) -> DataFrame:
    """(year, month, n_days) of each given year."""
    months = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return months.withColumn("n_days", F.day(F.last_day(F.make_date("year", "month", F.lit(1)))))


def zone_groups(zones: DataFrame) -> DataFrame:
    return zones.groupBy("zone_group").agg(F.sort_array(F.collect_list("zone_id")).alias("ids"))


def grid(pixels: DataFrame, value: str, nodata: float | None) -> DataFrame:
    """The pixel table with nodata, NaN and the infinities as NULL."""
    return pixels.withColumn(value, finite(F.col(value), nodata))


def polygons(vertices: DataFrame) -> DataFrame:
    """(poly_id, ring) with the vertices in order."""
    ring = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return vertices.groupBy("poly_id").agg(F.transform(ring, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The scenario table: empty and "None" are NULL, years are whole numbers and flags booleans."""
    raw = lookup_csv(spark, path, SCENARIO, "scenario table")
    clean = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("None"))
    kind = {"n_years": "int", "red_till": "boolean", "save_co2": "boolean"}
    return raw.select(*[clean(c).cast(kind.get(c, "string")).alias(c) for c in raw.columns])


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_path, suffix with its dot) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_path"))
    name = F.regexp_extract("file_path", "[^/]*$", 0)
    return files.select(name.alias("file_name"), "file_path", F.regexp_extract(name, r"(?<=.)\.[^.]*$", 0).alias("suffix"))


def write_grid(
    df: DataFrame, path: str, by: list[str], mode: str = "error", nodata: float | None = None, tags: dict[str, str] | None = None,
    grid: Grid | None = None,
) -> None:
    """Write a grid, a folder for each band; values become 4-byte, missing ones the nodata value if there is one.

    ``tags`` (units, long_name, description and the like) go to a table of their own beside the grid, and so does its
    record ``grid``, which ``grid_record`` reads.
    """
    values = [c for c, t in df.dtypes if t == "double" and c not in by]
    fill = lambda c: F.col(c) if nodata is None else F.coalesce(c, F.lit(nodata))
    df.withColumns({c: fill(c).cast("float") for c in values}).write.mode(mode).partitionBy(*by).parquet(path)
    kept = sorted((tags or {}).items()) + [("nodata", str(nodata))] * (nodata is not None)
    df.sparkSession.createDataFrame(kept, "tag string, value string").write.mode(mode).parquet(f"{path}-run_meta")
    if grid is not None:
        if grid.ncols is None or grid.nrows is None:
            raise ValueError("a grid's record needs its size")
        df.sparkSession.createDataFrame([asdict(grid)], GRID_RECORD).write.mode(mode).parquet(f"{path}-grid_meta")


def grid_record(spark: SparkSession, path: str) -> Grid:
    """The record that was written with a grid."""
    row = spark.read.schema(GRID_RECORD).parquet(f"{path}-grid_meta").first()
    return Grid(**{f.name: row[f.name] for f in fields(Grid)})


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A written grid with its nodata value as NULL, and its tags."""
    tags = {r["tag"]: r["value"] for r in spark.read.parquet(f"{path}-run_meta").collect()}
    df = spark.read.parquet(path)
    if "nodata" in tags:
        df = df.withColumns({c: F.nullif(F.col(c), F.lit(float(tags["nodata"])).cast("float")) for c, t in df.dtypes if t == "float"})
    return df, tags


def summary(df: DataFrame, metrics: dict[str, str], region: Column, practice: Column, notes: str = "") -> DataFrame:
    """Long rows region, practice, metric, value, unit, notes; metrics map a column to its unit."""
    parts = ", ".join(f"'{m}', cast({m} as double), '{u}'" for m, u in metrics.items())
    return df.select(region.alias("region"), practice.alias("practice"), F.expr(f"stack({len(metrics)}, {parts}) as (metric, value, unit)"), F.lit(notes).alias("notes"))


def write_summary(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for people."""
    df.select(*SUMMARY).coalesce(1).write.option("header", True).csv(path)


def write_if_absent(df: DataFrame, path: str, renew: bool = False) -> DataFrame:
    """Write unless a finished output exists (or always, with ``renew``), and read what is there.

    A folder that a broken job left half written has no commit marker and is written again.
    """
    if renew or not finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
