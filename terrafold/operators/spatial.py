"""Spatial joins and zonal statistics on plain columns.

A polygon layer has one row a vertex (poly_id, seq, x, y, and part for further rings); rings close themselves and the
even-odd rule over all rings decides what is inside, so holes and multiparts need nothing more.

Points meet polygons on strips: a polygon's edges are dealt to the strips of latitude that they meet, thinner ones the
more edges it has, so a test reads a few edges whatever the polygon. Cells of a grid need no test: a polygon's edges cross
the centre line of each row at sorted places, which pair into spans of columns. Sums over a span come from the running
sums of its row, so statistics need no list of cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from ..sources.layers import Grid, materialized
from . import ranks

#: Edges that a strip should hold, and halvings of a strip's height at most.
STRIP_EDGES, MOST_HALVINGS = 64, 16
#: Halvings from one level of edge tiles to the next.
LEVEL_STEP = 2


def edges(vertices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an edge: poly_id, x1, y1, x2, y2."""
    ring = ["poly_id", "part"] if "part" in vertices.columns else ["poly_id"]
    w = Window.partitionBy(*ring)
    nxt = lambda c: F.coalesce(F.lead(c).over(w.orderBy("seq")), F.min_by(c, "seq").over(w))
    return vertices.select("poly_id", *keep, F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def across_antimeridian(vertices: DataFrame) -> DataFrame:
    """Rings that step over longitude 180, made continuous and repeated one turn away, for joins with points in [-180, 180].

    A step of more than half a turn is one over the antimeridian. The two copies of a ring are apart, so the even-odd rule
    over both is right; areas and centroids are taken from the rings as given. Rings around a pole are not supported.
    """
    part = F.col("part") if "part" in vertices.columns else F.lit(0)
    rows = vertices.withColumn("part", part)
    ring = Window.partitionBy("poly_id", "part")
    step = F.col("x") - F.lag("x").over(ring.orderBy("seq"))
    turned = rows.withColumn("_turn", F.when(step > 180, -360).when(step < -180, 360).otherwise(0))
    turned = turned.withColumn("x", F.col("x") + F.sum("_turn").over(ring.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    over = F.when(F.max("x").over(ring) > 180, -360).when(F.min("x").over(ring) < -180, 360)
    both = turned.withColumn("_shift", over).withColumn("_shift", F.explode(F.when(F.col("_shift").isNotNull(), F.array(F.lit(0), "_shift")).otherwise(F.array(F.lit(0)))))
    return both.withColumns({"x": F.col("x") + F.col("_shift"), "part": F.col("part") * 2 + F.when(F.col("_shift") == 0, 0).otherwise(1)}).drop("_turn", "_shift")


def tile_range(low: Column, high: Column, size: float | Column) -> Column:
    return F.explode(F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int")))


def strips(vertices: DataFrame, size: float) -> DataFrame:
    """(poly_id, level, ty, edges, west, east): for each strip that a polygon meets, the edges in it and their extent.

    A strip of level k is ``size / 2^k`` high; a polygon's level gives its strips ``STRIP_EDGES`` edges on average.
    """
    own = Window.partitionBy("poly_id")
    e = edges(vertices)
    height = F.max(F.greatest("y1", "y2")).over(own) - F.min(F.least("y1", "y2")).over(own)
    crowd = F.count(F.lit(1)).over(own) / ((height / size + 1) * STRIP_EDGES)
    level = F.least(F.greatest(F.ceil(F.log2(crowd)), F.lit(0)), F.lit(MOST_HALVINGS)).cast("int")
    rows = e.withColumn("level", level).withColumn("ty", tile_range(F.least("y1", "y2"), F.greatest("y1", "y2"), size / F.pow(F.lit(2.0), "level")))
    return rows.groupBy("poly_id", "level", "ty").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"),
    )


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge is crossed by the ray from the point to the east; half-open in y, so that a vertex counts once."""
    at = (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"]
    return F.when((e["y1"] > y) != (e["y2"] > y), x < at).otherwise(False)


def touches(e: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on the edge, its ends included."""
    turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (turn == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd crossing test with half-open edges, so that shared borders have one owner."""
    return F.aggregate(ring, F.lit(False), lambda odd, e: odd != crosses(e, x, y))


def within(x: Column, y: Column, ring: Column) -> Column:
    """Inside and on no edge."""
    return inside(x, y, ring) & ~F.exists(ring, lambda e: touches(e, x, y))


def point_in_polygon(points: DataFrame, vertices: DataFrame, id_col: str, size: float = 8.0, border: bool = True) -> DataFrame:
    """(id, poly_id) of every polygon that a point lies in; a point in several polygons gives several rows.

    With ``border`` a point on a border shared by two polygons has one owner; without it a point on any border has none.
    """
    rows = strips(vertices, size)
    levels = F.broadcast(rows.select("level").distinct())  # at most MOST_HALVINGS + 1
    p = points.select(id_col, "x", "y", F.floor(F.col("x") / size).cast("int").alias("tx")).crossJoin(levels)
    p = p.withColumn("ty", F.floor(F.col("y") / (size / F.pow(F.lit(2.0), "level"))).cast("int"))
    # Points meet the narrow extents first; the edges follow by polygon and strip, so they are not copied to every tile.
    tiles = rows.select("poly_id", "level", "ty", tile_range(F.col("west"), F.col("east"), size).alias("tx"))
    near = p.join(tiles, ["level", "tx", "ty"]).drop("tx")
    test = (inside if border else within)(F.col("x"), F.col("y"), F.col("edges"))
    return near.join(rows.drop("west", "east"), ["poly_id", "level", "ty"]).where(test).select(id_col, "poly_id")


def edge_levels(vertices: DataFrame, size: float) -> DataFrame:
    """The edges with their level: a tile of level k is ``size / 2^k`` wide, and an edge's is the least that is as wide as it."""
    width = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    halvings = F.floor(F.log2(size / F.greatest(width, F.lit(size / 2.0**MOST_HALVINGS))) / LEVEL_STEP) * LEVEL_STEP
    return edges(vertices).withColumn("level", F.greatest(halvings, F.lit(0)).cast("int"))


def edge_tiles(rows: DataFrame, other: DataFrame, size: float, first: bool) -> DataFrame:
    """``rows`` of ``edge_levels`` dealt to tiles (at, role, tx, ty), where they meet the edges of ``other`` whose extents meet theirs.

    Two edges meet at the coarser of their levels: an edge is dealt at its own and as a visitor at the coarser ones of
    the other layer. Roles keep visitors apart from visitors: 0 is own with own, 1 and 2 own with a visitor of the second
    and of the first layer. So short edges crowd no wide tile, however many there are.
    """
    theirs = F.broadcast(other.agg(F.collect_set("level").alias("_theirs")))  # at most MOST_HALVINGS / LEVEL_STEP + 1 numbers
    host, visitor = (1, 2) if first else (2, 1)
    place = lambda l, role: F.struct(l.alias("at"), F.lit(role).alias("role"))
    own = F.col("level")
    places = F.concat(
        F.transform(F.filter("_theirs", lambda l: l == own), lambda l: place(l, 0)),
        F.when(F.exists("_theirs", lambda l: l > own), F.array(place(own, host))).otherwise(F.array().cast("array<struct<at:int,role:int>>")),
        F.transform(F.filter("_theirs", lambda l: l < own), lambda l: place(l, visitor)),
    )
    dealt = rows.crossJoin(theirs).withColumn("_p", F.explode(places)).select(*rows.columns, "_p.at", "_p.role")
    wide = size / F.pow(F.lit(2.0), "at")
    dealt = dealt.withColumn("tx", tile_range(F.least("x1", "x2"), F.greatest("x1", "x2"), wide))
    return dealt.withColumn("ty", tile_range(F.least("y1", "y2"), F.greatest("y1", "y2"), wide)).drop("level")


def polygon_intersects(left: DataFrame, right: DataFrame, size: float = 8.0) -> DataFrame:
    """Distinct (a, b) of polygons of both layers that share a point, be it one of their borders only.

    Edges meet if their extents do and neither lies strictly on one side of the other's line, which holds for ends on
    edges, common corners and edges that overlap as well. Where no edges meet, each ring lies wholly inside or outside the
    other polygon, so one vertex of each ring tells.
    """

    def dealt(rows: DataFrame, other: DataFrame, s: str) -> DataFrame:
        tiles = edge_tiles(rows, other, size, s == "a")
        return tiles.select(*tile, F.col("poly_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")])

    def side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
        return F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))

    def overlap(axis: str) -> Column:
        ends = [(F.col(f"{axis}1_{s}"), F.col(f"{axis}2_{s}")) for s in "ab"]
        return (F.least(*ends[0]) <= F.greatest(*ends[1])) & (F.least(*ends[1]) <= F.greatest(*ends[0]))

    a, b = ("x1_a", "y1_a", "x2_a", "y2_a"), ("x1_b", "y1_b", "x2_b", "y2_b")
    straddle = (side(*a, *b[:2]) * side(*a, *b[2:]) <= 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) <= 0)
    tile, one, two = ["at", "role", "tx", "ty"], edge_levels(left, size), edge_levels(right, size)
    met = dealt(one, two, "a").join(dealt(two, one, "b"), tile).where(overlap("x") & overlap("y") & straddle).select("a", "b")

    def corner(v: DataFrame) -> DataFrame:
        ring = ["poly_id", "part"] if "part" in v.columns else ["poly_id"]
        return v.groupBy(*ring).agg(F.min_by(F.struct("x", "y"), "seq").alias("p")).select(F.col("poly_id").alias("own"), "p.x", "p.y")

    a_in_b = point_in_polygon(corner(left), right, "own", size).select(F.col("own").alias("a"), F.col("poly_id").alias("b"))
    b_in_a = point_in_polygon(corner(right), left, "own", size).select(F.col("poly_id").alias("a"), F.col("own").alias("b"))
    return met.unionByName(a_in_b).unionByName(b_in_a).distinct()


def spans(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(poly_id, row_i, first, last): the runs of columns whose centres lie in a polygon, as the crossing test has it.

    Each edge gives one crossing for each row whose centre line it meets; a row's crossings, sorted, pair into runs. Work
    grows with the crossings and the runs, not with the cells.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    row_of = lambda y: F.floor((grid.y0 - y) / grid.dy - 0.5)  # noqa: E731  the row with its centre at or above y, give or take rounding
    y = grid.y0 - (F.col("row_i") + 0.5) * grid.dy
    top = F.greatest(row_of(high), F.lit(0))
    bottom = row_of(low) + 1 if grid.nrows is None else F.least(row_of(low) + 1, F.lit(grid.nrows - 1))
    rows = edges(vertices).where(low != high).withColumns({"_top": top.cast("int"), "_bottom": bottom.cast("int")}).where("_top <= _bottom")
    rows = rows.withColumn("row_i", F.explode(F.sequence("_top", "_bottom"))).where((F.col("y1") > y) != (F.col("y2") > y))
    at = (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1"))) + F.col("x1")
    met = rows.groupBy("poly_id", "row_i").agg(F.sort_array(F.collect_list(at)).alias("_x"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2)), lambda i: F.struct(F.get("_x", i).alias("w"), F.get("_x", i + 1).alias("e")))
    runs = met.select("poly_id", "row_i", F.explode(pairs).alias("p"))

    def first_from(x: Column) -> Column:
        """The least column whose centre is not west of x."""
        near, centre = F.ceil((x - grid.x0) / grid.dx - 0.5), lambda k: grid.x0 + (k + 0.5) * grid.dx
        return F.when(centre(near - 1) >= x, near - 1).when(centre(near) < x, near + 1).otherwise(near)

    first, last = first_from(F.col("p.w")), first_from(F.col("p.e")) - 1
    if grid.ncols is not None:
        last = F.least(last, F.lit(grid.ncols - 1))
    return runs.select("poly_id", "row_i", F.greatest(first, F.lit(0)).cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")


def cells_of_spans(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """(cell_id, poly_id) of the cells in the runs."""
    places = runs.select("poly_id", "row_i", F.explode(F.sequence("first", "last")).alias("col_i"))
    return cells.select("cell_id", "row_i", "col_i").join(places, ["row_i", "col_i"]).select("cell_id", "poly_id")


def span_moments(cells: DataFrame, runs: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(poly_id, by, n, mean, std) of the valid cells in each polygon's runs, from running sums along the rows.

    A run's ends are put among the cells of its row; the sums up to the last column less those up to the one before the
    first are the run's. Such differences would lose digits in floating point, so values become whole numbers, 2^44 for the
    farthest from the mean of all, and their sums and squares are exact decimals. Polygons without a valid cell have no
    row.
    """
    wide = F.greatest(F.max(value) - F.avg(value), F.avg(value) - F.min(value))
    frame = F.broadcast(cells.agg(F.avg(value).alias("_centre"), F.when(wide > 0, F.lit(2.0**44) / wide).otherwise(1.0).alias("_scale")))
    v = F.round((F.col(value) - F.col("_centre")) * F.col("_scale")).cast("decimal(15,0)")
    own = cells.crossJoin(frame).where(F.col(value).isNotNull()).select(
        *by, "row_i", "col_i", F.lit(None).cast(runs.schema["poly_id"].dataType).alias("poly_id"), F.lit(0).alias("sign"), v.alias("v")
    )
    ends = F.explode(F.array(F.struct((F.col("first") - 1).alias("col_i"), F.lit(-1).alias("sign")), F.struct(F.col("last").alias("col_i"), F.lit(1).alias("sign"))))
    asked = runs.select("row_i", "poly_id", ends.alias("e"))
    if by:  # each run is asked once for every layer
        asked = asked.crossJoin(F.broadcast(cells.select(*by).distinct()))
    asked = asked.select(*by, "row_i", "e.col_i", "poly_id", "e.sign", F.lit(None).cast("decimal(15,0)").alias("v"))
    along = Window.partitionBy(*by, "row_i").orderBy("col_i", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    run = own.unionByName(asked).withColumns({"_n": F.count("v").over(along), "_s": F.sum("v").over(along), "_q": F.sum(F.col("v") * F.col("v")).over(along)})
    keys = ["poly_id", *by]
    signed = lambda c: F.sum(F.when(F.col("sign") > 0, F.coalesce(c, F.lit(0))).otherwise(-F.coalesce(c, F.lit(0))))
    sums = run.where("sign <> 0").groupBy(*keys).agg(signed("_n").alias("n"), signed("_s").cast("decimal(38,0)").alias("_s"), signed("_q").cast("decimal(38,0)").alias("_q"))
    sums = sums.where("n > 0").withColumn("_m", F.expr("cast(_s div n as decimal(15,0))"))
    apart = F.expr("cast(_q - cast(2 * _m * _s as decimal(38,0)) + cast(cast(n as decimal(14,0)) * _m * _m as decimal(38,0)) as double)")  # squares about the whole mean
    rest = F.expr("cast(_s - cast(_m * cast(n as decimal(14,0)) as decimal(38,0)) as double)") / F.col("n")
    std = F.sqrt(F.greatest(apart / F.col("n") - rest * rest, F.lit(0.0))) / F.col("_scale")
    mean = (F.col("_m").cast("double") + rest) / F.col("_scale") + F.col("_centre")
    return sums.crossJoin(frame).select(*keys, "n", mean.alias("mean"), std.alias("std"))


def mercator_area(vertices: DataFrame) -> DataFrame:
    """(poly_id, area) in square metres of the spherical Mercator plane; rings inside others count negative by winding."""
    x, y = formulas.mercator(F.col("x"), F.col("y"))
    e = edges(vertices.withColumns({"x": x, "y": y}))
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return e.groupBy("poly_id").agg((F.abs(twice) / 2).alias("area"))


def centroid(vertices: DataFrame) -> DataFrame:
    """One row: the centroid of all polygons together (those that overlap count twice where they do)."""
    c = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    per = edges(vertices).groupBy("poly_id").agg(
        F.sum(c).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * c).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * c).alias("my")
    )
    sign = F.signum("a2")
    total = F.sum(sign * F.col("a2")) * 3
    return per.agg(F.try_divide(F.sum(sign * F.col("mx")), total).alias("lon"), F.try_divide(F.sum(sign * F.col("my")), total).alias("lat"))


def split_latitude(vertices: DataFrame) -> DataFrame:
    """(poly_id, valid): whether a polygon's bounding box stays between the poles."""
    return vertices.groupBy("poly_id").agg(((F.min("y") >= -90) & (F.max("y") <= 90)).alias("valid"))


def zonal(cells: DataFrame, runs: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, lower median and population deviation of the valid cells of each polygon (and ``by``); empty ones are left out."""
    keys = ["poly_id", *by]
    moments = span_moments(cells, runs, value, by).select(*keys, F.col("mean").alias("cf"), F.col("std").alias("cf_std"))
    # Cells are listed for the median alone, which no sums give.
    held = cells.select("cell_id", *by, F.col(value).alias("v")).where("v is not null")
    held = held.join(cells_of_spans(cells.select("cell_id", "row_i", "col_i").distinct() if by else cells, runs), "cell_id").select(*keys, "v")
    held = ranks.quantiles(materialized(held, "zonal"), "v", [0.5], keys, discrete=True)
    return ranks.beside(moments, held, keys).select(*keys, "cf", F.get("q", F.lit(0)).alias("cf_median"), "cf_std")


#: The columns that name a region, and what each is called in the result, by kind of area (fixed names).
AREAS = {
    "Ecoregion": {"poly_id": "ecoregion_geom_id", "eco_name": "ecoregion_name", "biome_name": "Biome"},
    "Country": {"adm0_name": "country"},
    "Subcountry": {"adm0_name": "country", "adm1_name": "subcountry (adm1)"},
}


def zonal_report(stats: DataFrame, borders: DataFrame, area_type: str, impact_category: str, flow_name: str, unit: str) -> DataFrame:
    """Zonal statistics with the names of their regions and the labels of the layer; an unknown kind of area raises.

    One row a polygon of ``borders`` with statistics: polygons are told apart by poly_id, so regions of one name stay
    apart.
    """
    if area_type not in AREAS:
        raise ValueError(f"area_type must be one of {', '.join(AREAS)}: {area_type}")
    names = [F.col(c).alias(n) for c, n in AREAS[area_type].items()]
    labels = [F.lit(v).alias(n) for n, v in (("impact_category", impact_category), ("flow_name", flow_name), ("Unit", unit))]
    rows = borders.join(stats.select("poly_id", "cf", "cf_median", "cf_std"), "poly_id")
    return rows.select(*names, *labels, "cf", "cf_median", "cf_std")


def polygon_means(cells: DataFrame, runs: DataFrame, polygons: DataFrame, value: str) -> DataFrame:
    """Mean of each polygon's valid cells, NULL for none; every polygon has a row."""
    return polygons.select("poly_id").distinct().join(span_moments(cells, runs, value).select("poly_id", "mean"), "poly_id", "left")


def area_weighted(pairs: DataFrame, layer: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs (a, b) with value v and whole area w of the layer's polygon b."""
    values = layer.groupBy("poly_id").agg(F.first("v").alias("v")).join(areas, "poly_id")
    return pairs.join(values.select(F.col("poly_id").alias("b"), "v", F.col("area").alias("w")), "b")


def area_weighted_stats(borders: DataFrame, layer: DataFrame, names: DataFrame, by: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Area-weighted mean, population deviation and plain median of a layer's values by a name of the borders it meets.

    Returns the statistics (``by``, ``out``, ``out_std``, ``out_median``) and poly_id of the layer's polygons that reach
    beyond the poles, which take no part. ``names`` has a, a border's id, and the name. Pairs are found once.
    """
    valid = split_latitude(layer)
    kept = layer.join(valid.where("valid").select("poly_id"), "poly_id", "left_semi")
    pairs = area_weighted(polygon_intersects(borders, kept), kept, mercator_area(kept)).where(F.col("v").isNotNull()).join(names, "a")
    pairs = materialized(pairs.select(by, "v", "w"), "named-pairs")  # read for the mean and twice for the median
    own = Window.partitionBy(by)
    pairs = pairs.withColumn("_m", F.sum(F.col("v") * F.col("w")).over(own) / F.sum("w").over(own))
    spread = F.sqrt(F.sum(F.col("w") * (F.col("v") - F.col("_m")) * (F.col("v") - F.col("_m"))) / F.sum("w"))
    stats = pairs.groupBy(by).agg(F.first("_m").alias(out), spread.alias(f"{out}_std"))
    middle = ranks.quantiles(pairs, "v", [0.5], [by]).select(by, F.get("q", F.lit(0)).alias(f"{out}_median"))
    return stats.join(middle, by), valid.where(~F.col("valid")).select("poly_id")


def rasterize(cells: DataFrame, vertices: DataFrame, values: DataFrame, grid: Grid, fill: Column | None = None) -> DataFrame:
    """(cell_id, value): the value of the last polygon over each cell's centre, ``fill`` elsewhere."""
    owners = cells_of_spans(cells, spans(vertices, grid)).join(values, "poly_id")
    burnt = owners.groupBy("cell_id").agg(F.max_by("v", "poly_id").alias("v"))
    return cells.select("cell_id").join(burnt, "cell_id", "left").select("cell_id", F.coalesce("v", fill if fill is not None else F.lit(None)).alias("value"))


def sample_at_points(points: DataFrame, cells: DataFrame, value: str, x0: float, y0: float, step: float) -> DataFrame:
    """The value of the cell under each point, NULL outside the grid."""
    row, col = F.floor((y0 - F.col("y")) / step).cast("int"), F.floor((F.col("x") - x0) / step).cast("int")
    layer = cells.select("row_i", "col_i", F.col(value).alias("value"))
    return points.withColumns({"row_i": row, "col_i": col}).join(layer, ["row_i", "col_i"], "left").select("point_id", "value")
