"""Regridding between layers of one frame: equal joins on row and column, never a search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import from_mercator, mercator
from ..sources.layers import Grid


def in_system(df: DataFrame, crs: str, to: str) -> DataFrame:
    """Columns x and y of one reference system in another: degrees and spherical Mercator metres, others raise."""
    if crs == to:
        return df
    forms = {("EPSG:4326", "EPSG:3857"): mercator, ("EPSG:3857", "EPSG:4326"): from_mercator}
    if (crs, to) not in forms:
        raise ValueError(f"no closed form from {crs} to {to}")
    x, y = forms[crs, to](F.col("x"), F.col("y"))
    return df.withColumns({"x": x, "y": y})


def onto(target: DataFrame, source: DataFrame, value: str, grid: Grid, crs: str = "EPSG:4326") -> DataFrame:
    """(id, value): each target centre (id, x, y in ``crs``) takes the cell of the source, a grid of its own, under it.

    Centres outside the source's extent have no value.
    """
    return nearest(in_system(target, crs, grid.crs), source, value, grid.x0, grid.y0, grid.dx, grid.dy)


def nearest(target: DataFrame, source: DataFrame, value: str, x0: float, y0: float, step: float, dy: float | None = None) -> DataFrame:
    """(id, value): each target centre (id, x, y) takes the source cell under it; bands of the source stay apart."""
    bands = [c for c in source.columns if c == "band"]
    place = target.select("id", F.floor((y0 - F.col("y")) / (dy or step)).cast("int").alias("row_i"), F.floor((F.col("x") - x0) / step).cast("int").alias("col_i"))
    return place.join(source.select("row_i", "col_i", *bands, F.col(value).alias("value")), ["row_i", "col_i"], "left").select("id", *bands, "value")


def bilinear(target: DataFrame, source: DataFrame, value: str, x0: float, y0: float, step: float) -> DataFrame:
    """(id, value): the mean of the four nearest source centres by distance, missing ones left out."""
    fx, fy = (F.col("x") - x0) / step - 0.5, (y0 - F.col("y")) / step - 0.5
    at = target.select("id", fx.alias("fx"), fy.alias("fy"), F.floor(fx).cast("int").alias("c"), F.floor(fy).cast("int").alias("r"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (0, 1) for j in (0, 1)]))
    wing = lambda f, k, d: F.when(d == 0, 1 - (f - k)).otherwise(f - k)
    near = at.withColumn("k", corners).select(
        "id", (F.col("r") + F.col("k.dr")).alias("row_i"), (F.col("c") + F.col("k.dc")).alias("col_i"),
        (wing(F.col("fy"), F.col("r"), F.col("k.dr")) * wing(F.col("fx"), F.col("c"), F.col("k.dc"))).alias("w"),
    )
    both = near.join(source.select("row_i", "col_i", F.col(value).alias("v")).where("v is not null"), ["row_i", "col_i"], "left")
    return both.groupBy("id").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias("value"))


def block_average(source: DataFrame, value: str, width: int, height: int, scale: float) -> DataFrame:
    """(row_b, col_b, value): means of blocks of a grid shrunk to int(width * scale) by int(height * scale)."""
    w, h = int(width * scale), int(height * scale)
    block = lambda c, new, old: F.floor(F.col(c) * new / old).cast("int")
    return source.groupBy(block("row_i", h, height).alias("row_b"), block("col_i", w, width).alias("col_b")).agg(F.avg(value).alias("value"))


def with_near_mean(cells: DataFrame, value: str, name: str = "near", tile: int = 256) -> DataFrame:
    """The cells and one more column: the inverse-distance mean of the valid ones among the eight neighbours.

    Cells go to square tiles, those on a rim also to the tiles beside it, so the whole table is read and shuffled once and
    no task holds more than a tile. In a tile one order by row and column serves all neighbours: each is a range of one key.
    Cells without a place have no neighbours; cells of one place count each; without a valid neighbour there is no mean.
    """
    wide = tile + 3  # a row of the tile, its two rims and a gap, so that no neighbour wraps to another row
    tiles = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (0, -1, 1)]))
    dealt = cells.withColumn("_tile_row", F.explode(tiles("row_i"))).withColumn("_tile_col", F.explode(tiles("col_i")))
    row, col = F.col("row_i") - F.col("_tile_row") * tile + 1, F.col("col_i") - F.col("_tile_col") * tile + 1
    dealt = dealt.withColumn("_at", (row * wide + col).cast("long"))
    order = Window.partitionBy("_tile_row", "_tile_col").orderBy("_at")
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, j in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]:
        there, w = order.rangeBetween(i * wide + j, i * wide + j), (i * i + j * j) ** -0.5
        total = total + F.coalesce(F.sum(F.col(value).cast("double")).over(there), F.lit(0.0)) * w
        weight = weight + F.count(value).over(there) * w
    placed = F.col("row_i").isNotNull() & F.col("col_i").isNotNull()
    met = dealt.withColumns({"_total": total, "_weight": weight})
    own = [F.col(t).eqNullSafe(F.floor(F.col(c) / tile)) for t, c in (("_tile_row", "row_i"), ("_tile_col", "col_i"))]
    met = met.where(own[0] & own[1]).withColumn(name, F.when(placed & (F.col("_weight") > 0), F.col("_total") / F.col("_weight")))
    return met.select(*cells.columns, name)


def fill_gaps(cells: DataFrame, value: str, among: Column | None = None) -> DataFrame:
    """(cell_id, value): a missing value becomes the inverse-distance mean of the valid eight neighbours, one pass."""
    near = F.col("near") if among is None else F.when(among, F.col("near"))
    return with_near_mean(cells, value).select("cell_id", F.coalesce(F.col(value), near).alias("value"))


def nearest_in_row(row: int, columns: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted column of a row the place of the nearest site, given the nearest site of every column.

    Squared distances along the row are parabolas, one a column; their lower envelope is built from left to right. Each
    parabola is raised by the rank of its site's (row, column), under one unit of distance, so that no two are ever equal
    and ties go to the least row, then the least column.
    """
    low, wide = int(rows.min()), int(columns.max() - columns.min()) + 1
    unit = (int(rows.max()) - low + 1) * wide
    left = int(columns.min())
    stack: list[tuple[int, int, int, int]] = []  # first column of rule, column, height, place
    for place, (col, site) in enumerate(zip(columns.tolist(), rows.tolist(), strict=True)):
        height, start = (row - site) ** 2 * unit + (site - low) * wide + col - left, -(1 << 62)
        while stack:
            _, other, lower, _ = stack[-1]
            start = (height + unit * col * col - lower - unit * other * other) // (2 * unit * (col - other)) + 1
            if start > stack[-1][0]:
                break
            stack.pop()
            start = -(1 << 62)
        stack.append((start, col, height, place))
    ruled = np.searchsorted(np.array([s[0] for s in stack]), wanted, side="right") - 1
    return np.array([s[3] for s in stack])[ruled]


def nearest_valid(cells: DataFrame, value: str) -> DataFrame:
    """(cell_id, value): a hole takes the nearest valid cell by row and column, the least (row, col) on ties.

    Done one axis at a time. In a column each valid cell is the nearest one for the rows up to halfway to the next; in a
    row that has holes, the nearest cells of all columns give a lower envelope of parabolas. So there is one sort by
    column and one by row and no search; the work is that of the rows with holes times the columns with valid cells. Rows
    and columns may be negative; without any valid cell holes stay empty.
    """
    holes = cells.where(F.col(value).isNull()).select("cell_id", F.col("row_i").alias("hole_row"), F.col("col_i").alias("hole_col"))
    valid = cells.where(F.col(value).isNotNull()).select("row_i", "col_i", F.col(value).cast("double").alias("v")).distinct()
    extent = F.broadcast(holes.agg(F.min("hole_row").alias("_low"), F.max("hole_row").alias("_high")))
    column = Window.partitionBy("col_i").orderBy("row_i")
    from_row = F.coalesce(F.floor((F.lag("row_i").over(column) + F.col("row_i")) / 2) + 1, F.col("_low"))
    to_row = F.coalesce(F.floor((F.lead("row_i").over(column) + F.col("row_i")) / 2), F.col("_high"))
    sites = valid.crossJoin(extent).withColumns({"_from": from_row, "_to": to_row})
    sites = sites.withColumns({"_from": F.greatest("_from", "_low").cast("int"), "_to": F.least("_to", "_high").cast("int")}).where("_from <= _to")
    sites = sites.select(F.explode(F.sequence("_from", "_to")).alias("at_row"), "col_i", F.col("row_i").alias("site"), "v")
    sites = sites.join(holes.select(F.col("hole_row").alias("at_row")).distinct(), "at_row", "left_semi")

    def fill(key: tuple, wanted: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"cell_id": wanted["cell_id"], "value": np.nan})
        if len(met) and len(wanted):
            met = met.sort_values("col_i")
            place = nearest_in_row(int(key[0]), met["col_i"].to_numpy(), met["site"].to_numpy(), wanted["hole_col"].to_numpy())
            out["value"] = met["v"].to_numpy()[place]
        return out

    filled = holes.groupBy("hole_row").cogroup(sites.groupBy("at_row")).applyInPandas(fill, "cell_id long, value double")
    filled = filled.select("cell_id", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return cells.where(F.col(value).isNotNull()).select("cell_id", F.col(value).cast("double").alias("value")).unionByName(filled)
