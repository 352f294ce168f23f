"""Shared helpers: whitespace words, the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    trimmed = F.regexp_replace(whole(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]++"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or on a single machine one of our own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_own_shared", None)
    if own is None:
        own = spark.sparkContext._own_shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return own


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    if blocks := _open.get():
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Paths written inside each open ``temporary`` block of this thread, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What ``written`` writes inside is deleted on leaving; results that live on are written before and outside of it.

    Blocks belong to the thread that opens them, so queries of other threads neither see nor delete their tables.
    """
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        drop(spark, *paths)


def lasting(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` for a result: it stays when the innermost ``temporary`` block ends, and goes with the next one out."""
    out, path = written(df, name)
    if blocks := _open.get():
        blocks[-1].remove(path)
        if len(blocks) > 1:
            blocks[-2].append(path)
    return out, path


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The written rows with ``place``, gapless from 0 in the order of partitions and of rows within, and their number.

    The driver gets one count a partition; no task sees more than its own rows.
    """
    rows, _ = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    starts, n = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()):
        starts.append((r.part, n))
        n += r.rows
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _first long"))
    placed = rows.withColumn("_part", part).join(offsets, "_part").withColumn("place", F.col("_first") + inner)
    return placed.drop("_part", "_first", "_at"), n


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
