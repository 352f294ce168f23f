"""Cell-local map algebra, layer statistics and reporting, as columns, joins and groupings."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import finite, from_mercator
from ..sources.layers import Grid
from . import ranks
from .regrid import in_system

TINY_NODATA = -3.14e-8


def masked(value: Column, land_use: Column, fill: Column | None = None) -> Column:
    """The value inside the land use; ``fill`` (or NULL) elsewhere."""
    inside = F.when(land_use == 1, value)
    return inside if fill is None else F.coalesce(inside, fill)


def binarize(value: Column, nodata: float | None = 255) -> Column:
    """1 where valid; the nodata value (or NULL) elsewhere. A missing value is never valid."""
    return F.when(value.isNotNull(), F.lit(1.0)).otherwise(F.lit(nodata))


def binary_mask(value: Column, src_nodata: float | None, inside: float = 1.0, outside: float = TINY_NODATA) -> Column:
    """Two chosen values; a nodata value that is absent or zero makes every non-zero cell valid."""
    valid = value != (src_nodata or 0.0)
    return F.when(value.isNotNull() & valid, F.lit(inside)).otherwise(F.lit(outside))


def frame_of(cells: DataFrame, step: float, crs: str = "EPSG:4326") -> dict:
    """The record (as fields of ``Grid``) of cells with row_i, col_i and centres x, y that were written without one; one pass.

    Its size is that of the cells present, so a layer that lacks its last row gives another: keep records with layers.
    """
    at = cells.agg(
        F.min(F.col("x") - (F.col("col_i") + 0.5) * step).alias("x0"), F.max(F.col("y") + (F.col("row_i") + 0.5) * step).alias("y0"),
        (F.max("row_i") + 1).alias("nrows"), (F.max("col_i") + 1).alias("ncols"),
    ).first()
    return {"crs": crs, "dx": step, "dy": step, **at.asDict()}


def grid_of(record: Grid | dict) -> Grid:
    """A record from its fields; a corner of 0, 0 and steps of 1 where they are not given."""
    return record if isinstance(record, Grid) else Grid(**({"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0} | record))


def same_grid(a: Grid | dict, b: Grid | dict) -> None:
    """Raise unless two grids agree in reference system, corner, step and size, within a thousandth of a step."""
    grid_of(a).same(grid_of(b))


def grid_product(layers: list[DataFrame], frames: list[Grid | dict] | None = None) -> DataFrame:
    """(cell_id, value): the product of all layers; a missing factor makes a missing product.

    With ``frames``, layers whose grids differ raise.
    """
    if not layers:
        raise ValueError("at least one layer is needed")
    for frame in frames or []:
        same_grid(frames[0], frame)
    named = [d.select("cell_id", F.col("value").alias(f"v{i}")) for i, d in enumerate(layers)]
    joined = reduce(lambda a, b: a.join(b, "cell_id"), named)
    return joined.select("cell_id", reduce(lambda a, b: a * b, [F.col(f"v{i}") for i in range(len(layers))]).alias("value"))


def grid_difference(a: DataFrame, b: DataFrame, frame_a: Grid | dict, frame_b: Grid | dict) -> DataFrame:
    """(row_i, col_i, value): a - b on a's grid stretched over the union of both extents, missing unless both are there.

    b is sampled at the centres; rows and columns north and west of a's origin are negative.
    """
    frame_a, frame_b = grid_of(frame_a), grid_of(frame_b)
    if frame_a.crs != frame_b.crs:
        raise ValueError(f"layers must share a reference system: {frame_a.crs} and {frame_b.crs}")
    dx, dy = frame_a.dx, frame_a.dy
    west = floor((min(frame_a.x0, frame_b.x0) - frame_a.x0) / dx)
    north = floor((frame_a.y0 - max(frame_a.y0, frame_b.y0)) / dy)
    east = max(frame_a.ncols, ceil((frame_b.x0 + frame_b.ncols * frame_b.dx - frame_a.x0) / dx))
    south = max(frame_a.nrows, ceil((frame_a.y0 - frame_b.y0 + frame_b.nrows * frame_b.dy) / dy))
    wide, cell = east - west, F.col("id")
    union = a.sparkSession.range((south - north) * wide).select(
        (F.floor(cell / wide) + north).cast("int").alias("row_i"), (cell % wide + west).cast("int").alias("col_i")
    )
    x, y = pixel_centre(F.col("row_i"), F.col("col_i"), frame_a.x0, frame_a.y0, dx)
    under_row, under_col = F.floor((frame_b.y0 - y) / frame_b.dy).cast("int"), F.floor((x - frame_b.x0) / frame_b.dx).cast("int")
    union = union.withColumns({"_r": under_row, "_c": under_col})
    left = a.select("row_i", "col_i", F.col("value").alias("va"))
    right = b.select(F.col("row_i").alias("_r"), F.col("col_i").alias("_c"), F.col("value").alias("vb"))
    return union.join(left, ["row_i", "col_i"], "left").join(right, ["_r", "_c"], "left").select("row_i", "col_i", (F.col("va") - F.col("vb")).alias("value"))


def mask_by_overlap(a: DataFrame, b: DataFrame, grid_a: Grid, grid_b: Grid) -> DataFrame:
    """The rows of a (row_i, col_i and more) whose cell is valid in b; on another grid, in the cell of b under its centre."""
    valid = b.where("value is not null")
    try:
        grid_a.same(replace(grid_b, ncols=grid_a.ncols, nrows=grid_a.nrows))
    except ValueError:
        x, y = grid_a.x0 + (F.col("col_i") + 0.5) * grid_a.dx, grid_a.y0 - (F.col("row_i") + 0.5) * grid_a.dy
        places = in_system(a.select("row_i", "col_i", x.alias("x"), y.alias("y")), grid_a.crs, grid_b.crs)
        under = [F.floor((grid_b.y0 - F.col("y")) / grid_b.dy).cast("int").alias("_r"), F.floor((F.col("x") - grid_b.x0) / grid_b.dx).cast("int").alias("_c")]
        held = valid.select(F.col("row_i").alias("_r"), F.col("col_i").alias("_c"))
        valid = places.select("row_i", "col_i", *under).join(held, ["_r", "_c"], "left_semi")
    return a.join(valid.select("row_i", "col_i"), ["row_i", "col_i"], "left_semi")


def pct_change(rows: DataFrame, key: list[str]) -> DataFrame:
    """Percent change of column value against the first year of each key."""
    first = F.first("value").over(Window.partitionBy(*key).orderBy("year"))
    return rows.select(*key, "year", change(first).alias("pct"))


def change(start: Column) -> Column:
    """Percent change of column value against its start, where rows hold that beside it and need no window."""
    return (F.try_divide("value", start) - 1) * 100


def practice_benefit(base: DataFrame, other: DataFrame, base_year: int, other_year: int) -> DataFrame:
    """Percent by which one practice's year exceeds the other's, by cell."""
    one = base.where(F.col("year") == base_year).select("cell_id", F.col("value").alias("v1"))
    two = other.where(F.col("year") == other_year).select("cell_id", F.col("value").alias("v2"))
    # Both have a row a cell, far more in memory than their plans look on disk.
    return one.join(two.hint("merge"), "cell_id").select("cell_id", ((F.try_divide("v2", "v1") - 1) * 100).alias("benefit"))


def pixel_centre(row: Column, col: Column, x0: float, y0: float, step: float, crs: str = "EPSG:4326") -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre; grids in degrees or in spherical Mercator metres, others raise."""
    x, y = x0 + (col + 0.5) * step, y0 - (row + 0.5) * step
    if crs == "EPSG:3857":
        return from_mercator(x, y)
    if crs != "EPSG:4326":
        raise ValueError(f"no closed form from {crs} to longitude and latitude")
    return x, y


def tile_years(monthly: DataFrame, n_years: int, key: str = "cell_id") -> DataFrame:
    """Each key's months for n years, with year (from 1) and t (month from 0).

    A key has twelve months, which repeat, or twelve for each year, numbered on; other lengths raise.
    """
    values = [c for c in monthly.columns if c not in (key, "month")]
    packed = monthly.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("month", *values))).alias("_m"))
    sized = F.when(F.size("_m").isin(12, 12 * n_years), F.col("_m")).otherwise(F.raise_error(F.lit("drivers must hold 12 or 12 * n_years months")))
    rows = packed.select(key, sized.alias("_m"), F.explode(F.sequence(F.lit(0), F.lit(12 * n_years - 1))).alias("t"))
    at = F.col("_m")[F.col("t") % F.size("_m")]
    return rows.select(
        key, (F.floor(F.col("t") / 12) + 1).cast("int").alias("year"), (F.col("t") % 12 + 1).alias("month"), "t", *[at[v].alias(v) for v in values]
    )


def incomplete_cells(monthly: DataFrame) -> DataFrame:
    """Cells without twelve bands."""
    return monthly.groupBy("cell_id").agg(F.count_distinct("month").alias("bands")).where("bands <> 12")


def drop_low(df: DataFrame, value: str, threshold: float | None = None) -> Column | DataFrame:
    """The frame with values at or under the threshold (the least value if none is given) made missing."""
    if threshold is not None:
        return df.withColumn(value, F.when(F.col(value) > threshold, F.col(value)))
    low = df.agg(F.min(value).alias("_low"))
    return df.crossJoin(F.broadcast(low)).withColumn(value, F.when(F.col(value) > F.col("_low"), F.col(value))).drop("_low")


def log10_offset(df: DataFrame, value: str) -> DataFrame:
    """log10 of the value plus a hundredth of the least value's size; missing where that is not positive."""
    low = F.broadcast(df.agg((F.abs(F.min(value)) / 100).alias("_shift")))
    moved = F.col(value) + F.col("_shift")
    return df.crossJoin(low).withColumn(value, F.when(moved > 0, F.log10(moved))).drop("_shift")


def region_match(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of which a column matches, without regard to case; none raises."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in columns])
    found = df.where(hit)
    if found.isEmpty():
        raise ValueError(f"no region matches {pattern}")
    return found


def value_format(df: DataFrame, value: str) -> DataFrame:
    """Column label: scientific with two places if the median is under a hundredth, else fixed."""
    mid = F.broadcast(ranks.quantiles(df, value, [0.5]).select(F.get("q", F.lit(0)).alias("_mid")))
    text = F.when(F.col("_mid") < 1e-2, F.format_string("%.2e", F.col(value))).otherwise(F.format_string("%.2f", F.col(value)))
    return df.crossJoin(mid).withColumn("label", text).drop("_mid")


TILLAGE_FACTOR = {"conventional": 1.0, "reduced": 0.35, "none": 0.25}  # fixed values


def soil_loss(erosivity: Column, c_crop: Column, tillage: str, residue_share: Column, cover_share: Column) -> Column:
    """Erosivity times cover factor: crop, tillage, residues and winter cover."""
    return erosivity * c_crop * TILLAGE_FACTOR[tillage] * (1 - 0.12 * residue_share) * (1 - 0.2 * cover_share)


def band_stats(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("band").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def timeseries(rows: DataFrame, value: str = "value") -> DataFrame:
    """Mean and quartiles by label and year, of those with a value; the rows are read three times."""
    means = rows.groupBy("label", "year").agg(F.avg(value).alias("mean"))
    held = ranks.quantiles(rows, value, [0.25, 0.75], ["label", "year"], few=True)  # labels are named by people, so years of them are few
    return ranks.beside(means, held, ["label", "year"]).select("label", "year", "mean", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin from 1, n) of equal widths between the least and greatest value; the last bin is closed."""
    ends = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    place = F.least(F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))) + 1, F.lit(bins))
    return df.where(F.col(value).isNotNull()).crossJoin(ends).groupBy(F.coalesce(place, F.lit(1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentile_clip(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    ends = F.broadcast(ranks.quantiles(df, value, [low, high]).select(F.get("q", F.lit(0)).alias("_lo"), F.get("q", F.lit(1)).alias("_hi")))
    return df.crossJoin(ends).withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")


def quantile_bins(df: DataFrame, value: str, q: int) -> DataFrame:
    """Adds bin (from 1; (lo, hi], the first closed) and the bin's midpoint; equal edges merge."""
    edges = F.broadcast(ranks.quantiles(df, value, [i / q for i in range(q + 1)]).select(F.array_distinct("q").alias("_e")))
    place = F.least(F.greatest(F.size(F.filter("_e", lambda e: e < F.col(value))), F.lit(1)), F.size("_e") - 1)
    out = df.crossJoin(edges).withColumn("bin", F.when(F.col(value).isNotNull(), place))
    mid = (F.try_element_at("_e", F.col("bin")) + F.try_element_at("_e", F.col("bin") + 1)) / 2
    return out.withColumn("mid", mid).drop("_e")


def value_profile(df: DataFrame, value: str, classes: int = 20) -> DataFrame:
    """One row: distinct values, range, whether few enough to be classes, and then the midpoints between neighbours."""
    some = df.agg(F.count_distinct(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    # The midpoints are those of a few classes, so one value more than these is all that is ever gathered.
    few = df.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct().limit(classes + 1)
    held = F.broadcast(few.agg(F.sort_array(F.collect_list("v")).alias("_v")))
    between = F.transform(F.slice("_v", 2, classes), lambda v, i: (v + F.col("_v")[i]) / 2)
    return (
        some.crossJoin(held).withColumn("categorical", F.col("n") <= classes)
        .withColumn("boundaries", F.when(F.col("categorical"), between)).drop("_v")
    )


def diagnostics(df: DataFrame, value: str, geometry: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(geometry).isNull()).alias("no_geometry"), F.count_if(finite(F.col(value)).isNull()).alias("not_finite"))
