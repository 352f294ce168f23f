"""Contacts, spans, running sums and nearest cells against plain geometry and plain search."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import algebra, regrid, spatial
from terrafold.sources.layers import Grid

VERTICES = "poly_id long, part int, seq int, x double, y double"


def layer(spark, polygons):
    """Vertices of {id: [ring, ...]}."""
    rows = [(i, p, s, float(x), float(y)) for i, rings in polygons.items() for p, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, VERTICES)


def square(x, y, w=2, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def sides(rings):
    return [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on_side(p, rings):
    return any(turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]) for a, b in sides(rings))


def holds(p, rings):
    odd = False
    for a, b in sides(rings):
        if (a[1] > p[1]) != (b[1] > p[1]):
            odd ^= p[0] < Fraction(b[0] - a[0]) * Fraction(p[1] - a[1]) / Fraction(b[1] - a[1]) + a[0]
    return odd


def meet(one, two):
    """Whether two segments share a point: parameters of the crossing, or overlap on one line."""
    (a, b), (c, d) = one, two
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    cross = r[0] * s[1] - r[1] * s[0]
    if cross:
        t = Fraction((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0], cross)
        u = Fraction((c[0] - a[0]) * r[1] - (c[1] - a[1]) * r[0], cross)
        return 0 <= t <= 1 and 0 <= u <= 1
    return any(on_side(p, [[*q]]) for p, q in ((a, two), (b, two), (c, one), (d, one)))


def shares_point(one, two):
    return any(meet(a, b) for a in sides(one) for b in sides(two)) or holds(one[0][0], two) or holds(two[0][0], one)


def random_polygon(rng):
    x, y = rng.randint(0, 20), rng.randint(0, 20)
    ring = [(x + rng.randint(0, 6), y + rng.randint(0, 6)) for _ in range(rng.randint(3, 6))]
    return [ring]


def test_touching_polygons_intersect(spark):
    base = {1: [square(0, 0)]}
    others = {
        10: [square(2, 0.5, 1)], 11: [square(2, 2)], 12: [square(0, 0)], 13: [[(1, 2), (0, 4), (2, 4)]], 14: [square(0.5, 0.5, 1)], 15: [square(-3, -3, 9)],
        16: [square(2.01, 0)], 17: [square(5, 5)], 18: [square(-5, -5, 12), square(-1, -1, 4)], 19: [square(8, -1, 3), square(1, 1, 4)],
    }
    found = {(r.a, r.b) for r in spatial.polygon_intersects(layer(spark, base), layer(spark, others)).collect()}
    assert found == {(1, b) for b in (10, 11, 12, 13, 14, 15, 19)}  # 18 has a hole around it


@pytest.mark.parametrize("size", [0.5, 3.0, 8.0, 64.0])
def test_intersections_equal_plain_geometry(spark, size):
    rng = random.Random(11)
    one, two = ({i: random_polygon(rng) for i in range(60)} for _ in range(2))
    got = {(r.a, r.b) for r in spatial.polygon_intersects(layer(spark, one), layer(spark, two), size).collect()}
    assert got == {(a, b) for a, p in one.items() for b, q in two.items() if shares_point(p, q)}


def test_points_on_borders(spark):
    rng = random.Random(5)
    polygons = {i: random_polygon(rng) for i in range(40)} | {99: [square(2, 2, 12), square(5, 5, 4)]}
    at = [(x * 12 + y, float(x), float(y)) for x in range(24) for y in range(12)]
    points = spark.createDataFrame(at, "point_id long, x double, y double")
    got = {(r.point_id, r.poly_id) for r in spatial.point_in_polygon(points, layer(spark, polygons), "point_id", border=False).collect()}
    where = {i: (int(x), int(y)) for i, x, y in at}
    assert got == {(i, k) for i, p in where.items() for k, rings in polygons.items() if holds(p, rings) and not on_side(p, rings)}
    owned = {(r.point_id, r.poly_id) for r in spatial.point_in_polygon(points, layer(spark, polygons), "point_id").collect()}
    assert owned == {(i, k) for i, p in where.items() for k, rings in polygons.items() if holds(p, rings)} and owned > got


def test_many_edges_are_dealt_to_thin_strips(spark):
    """A polygon of 100 000 edges beside small ones: strips hold few edges, and answers stay those of a circle."""
    angle = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    ring = list(zip(30 * np.cos(angle), 30 * np.sin(angle), strict=True))
    polygons = layer(spark, {1: [ring]} | {i: [square(3 * i, 40, 1)] for i in range(2, 20)})
    rows = spatial.strips(polygons, 8.0)
    assert rows.where("poly_id > 1").select("level").distinct().collect() == [(0,)]
    sizes = [r.n for r in rows.where("poly_id = 1").select(F.size("edges").alias("n")).collect()]
    assert max(sizes) < 3000 and sorted(sizes)[len(sizes) // 2] <= 2 * spatial.STRIP_EDGES
    points = spark.range(4000).select(F.col("id").alias("point_id"), (F.rand(3) * 70 - 35).alias("x"), (F.rand(4) * 70 - 35).alias("y")).persist()
    got = {r.point_id for r in spatial.point_in_polygon(points, polygons, "point_id").where("poly_id = 1").collect()}
    assert got == {r.point_id for r in points.where("x * x + y * y < 900").collect()}


def test_short_edges_crowd_no_tile(spark):
    """Two rings of 20 000 edges and wide polygons: no tile pairs many edges, and the contacts are those of circles."""
    angle = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    circle = lambda x, r: [list(zip(x + r * np.cos(angle), r * np.sin(angle), strict=True))]
    one = layer(spark, {1: circle(0.0, 3.0), 2: [square(-20, -20, 40)], 3: [square(2.5, 0, 0.1)]})
    two = layer(spark, {11: circle(4.0, 3.0), 12: circle(20.0, 3.0), 13: [square(-1, 2.9, 30, 1)], 14: [square(-40, -40, 2)]})
    a, b = spatial.edge_levels(one, 8.0), spatial.edge_levels(two, 8.0)
    keys = ["at", "role", "tx", "ty"]
    tiles = spatial.edge_tiles(a, b, 8.0, True).groupBy(*keys).count().join(spatial.edge_tiles(b, a, 8.0, False).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    pairs = tiles.select((F.col("count") * F.col("n")).alias("p")).agg(F.max("p").alias("most"), F.sum("p").alias("all")).first()
    assert pairs["most"] < 50_000 and pairs["all"] < 1_000_000  # 4 * 10^8 pairs of short edges
    found = {(r.a, r.b) for r in spatial.polygon_intersects(one, two).collect()}
    assert found == {(1, 11), (1, 13), (2, 11), (2, 12), (2, 13), (3, 11)}


def test_polygons_across_the_antimeridian(spark):
    ring = {1: [[(170, 0), (-170, 0), (-170, 10), (170, 10)]], 2: [square(0, 0, 5)], 3: [[(178, 20), (-179, 20), (-179, 25), (178, 25)], [(179, 21), (179.5, 21), (179.5, 24), (179, 24)]]}
    points = spark.createDataFrame([(1, 175.0, 5.0), (2, -175.0, 5.0), (3, 0.5, 5.0), (4, 165.0, 5.0), (5, 2.0, 2.0), (6, -179.5, 22.0), (7, 179.2, 22.0)], "point_id long, x double, y double")
    wrapped = spatial.across_antimeridian(layer(spark, ring))
    got = {(r.point_id, r.poly_id) for r in spatial.point_in_polygon(points, wrapped, "point_id").collect()}
    assert got == {(1, 1), (2, 1), (5, 2), (6, 3)}


# --- spans and running sums


@pytest.fixture(scope="module")
def scene(spark):
    """A grid with gaps, and polygons with holes, shared borders, corners on centres and parts outside the grid."""
    rng = random.Random(2)
    grid = Grid(-3.0, 20.0, 0.5, 0.5, ncols=60, nrows=48)
    polygons = {i: random_polygon(rng) for i in range(30)} | {50: [square(1, 1, 12), square(4, 4, 3)], 51: [square(13, 1, 4, 12)], 52: [square(-40, -40, 41)], 53: [square(0.25, 0.25, 1)], 54: [square(100, 100)]}
    cells = [(r * 60 + k, r, k, -3 + (k + 0.5) * 0.5, 20 - (r + 0.5) * 0.5, rng.choice((None, 1000.0 + rng.random(), rng.random()))) for r in range(48) for k in range(60) if (r + k) % 7]
    return grid, layer(spark, polygons), spark.createDataFrame(cells, "cell_id long, row_i int, col_i int, x double, y double, v double").persist()


def test_spans_equal_the_crossing_test(scene):
    grid, polygons, cells = scene
    runs = spatial.spans(polygons, grid).persist()
    got = {tuple(r) for r in spatial.cells_of_spans(cells, runs).collect()}
    want = {(r.cell_id, r.poly_id) for r in spatial.point_in_polygon(cells, polygons, "cell_id").collect()}
    assert got == want and {p for _, p in got} >= {50, 51, 52, 53}
    open_ended = spatial.spans(polygons, Grid(-3.0, 20.0, 0.5, 0.5))
    assert {tuple(r) for r in spatial.cells_of_spans(cells, open_ended).collect()} == want
    assert "Python" not in runs._jdf.queryExecution().executedPlan().toString()


def test_moments_from_running_sums(spark, scene):
    grid, polygons, cells = scene
    runs = spatial.spans(polygons, grid)
    owned = cells.join(spatial.cells_of_spans(cells, runs), "cell_id").where("v is not null")
    want = {r.poly_id: (r.n, r.m, r.s) for r in owned.groupBy("poly_id").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    got = {r.poly_id: (r.n, r["mean"], r["std"]) for r in spatial.span_moments(cells, runs, "v").collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-6)
    both = cells.withColumn("year", F.lit(1)).unionByName(cells.withColumns({"year": F.lit(2), "v": F.col("v") * 3}))
    twice = {(r.poly_id, r.year): r["mean"] for r in spatial.span_moments(both, runs, "v", ["year"]).collect()}
    assert twice == pytest.approx({(k, y): w[1] * (1, 3)[y - 1] for k, w in want.items() for y in (1, 2)})
    stats = {r.poly_id: r for r in spatial.zonal(cells, runs, "v").collect()}
    assert {k: r.cf for k, r in stats.items()} == pytest.approx({k: w[1] for k, w in want.items()})
    means = {r.poly_id: r["mean"] for r in spatial.polygon_means(cells, runs, polygons, "v").collect()}
    assert means[54] is None and means[50] == pytest.approx(want[50][1])
    assert spatial.span_moments(cells.limit(0), runs, "v").count() == 0


def test_zonal_report_names_regions_by_kind(spark):
    stats = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)], "poly_id long, cf double, cf_median double, cf_std double")
    borders = spark.createDataFrame([(1, "e", "b", "A", "s"), (2, "e", "b", "A", "s"), (3, "e", "b", "A", "s")], "poly_id long, eco_name string, biome_name string, adm0_name string, adm1_name string")
    tail = ["impact_category", "flow_name", "Unit", "cf", "cf_median", "cf_std"]
    for kind, head in (("Ecoregion", ["ecoregion_geom_id", "ecoregion_name", "Biome"]), ("Country", ["country"]), ("Subcountry", ["country", "subcountry (adm1)"])):
        out = spatial.zonal_report(stats, borders, kind, "erosion", "soil", "t/ha")
        assert out.columns == head + tail and out.count() == 2
    with pytest.raises(ValueError, match="area_type"):
        spatial.zonal_report(stats, borders, "Continent", "", "", "")


# --- nearest valid cells


def plain_nearest(rows):
    valid = [(r, k, v) for _, r, k, v in rows if v is not None]
    out = {}
    for i, r, k, v in rows:
        out[i] = v if v is not None else min(((r - a) ** 2 + (k - b) ** 2, a, b, w) for a, b, w in valid)[3] if valid else None
    return out


@pytest.mark.parametrize("case", ["dense", "sparse", "negative", "one", "far", "none", "full"])
def test_nearest_valid_equals_search(spark, case):
    rng = random.Random(case)
    share = {"dense": 0.4, "sparse": 0.9, "negative": 0.7, "one": 2, "far": 2, "none": 2, "full": 0}[case]
    shift = {"negative": (-60, -7)}.get(case, (0, 0))
    places = [(r + shift[0], k + shift[1]) for r in range(30) for k in range(25) if case != "sparse" or rng.random() < 0.5]
    rows = [(i, r, k, None if rng.random() < share else float(i)) for i, (r, k) in enumerate(places)]
    if case in ("one", "far"):
        rows[17] = (*rows[17][:3], 7.5)
    if case == "far":
        rows.append((10_000, 900, 4000, None))
    df = spark.createDataFrame(rows, "cell_id long, row_i int, col_i int, v double").repartition(5)
    assert {r.cell_id: r.value for r in regrid.nearest_valid(df, "v").collect()} == plain_nearest(rows)


def test_nearest_valid_plans_without_a_job(spark):
    df = spark.createDataFrame([(1, 0, 0, None), (2, 5, 5, 1.0)], "cell_id long, row_i int, col_i int, v double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    out = regrid.nearest_valid(df, "v")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("run", "run")
    assert out.count() == 2 and regrid.nearest_valid(df.limit(0), "v").count() == 0


# --- grid records


def test_grids_agree_by_record_not_by_cells(spark, tmp_path):
    from terrafold.sources import layers as io

    grid = Grid(0.05, 60.0, 1 / 120, 1 / 120, ncols=400, nrows=20, nodata=-9.0)
    cells = spark.range(400 * 19).select((F.col("id") / 400).cast("int").alias("row_i"), (F.col("id") % 400).cast("int").alias("col_i"), F.lit(1).alias("band"), F.lit(1.5).alias("value"))
    io.write_grid(cells, str(tmp_path / "g"), ["band"], nodata=-9.0, grid=grid)  # its last row is missing
    assert io.grid_record(spark, str(tmp_path / "g")) == grid
    Grid(0.05 + 1e-7, 60.0, 1 / 120, 1 / 120 + 1e-10, 400, 20).same(grid)
    for other, what in ((Grid(0.06, 60.0, 1 / 120, 1 / 120, 400, 20), "x0"), (Grid(0.05, 60.0, 1 / 120, 1 / 120, 400, 19), "nrows"), (Grid(0.05, 60.0, 1 / 120, 1 / 120, 400, 20, "EPSG:3857"), "crs")):
        with pytest.raises(ValueError, match=f"must match raster dimensions: {what}"):
            grid.same(other)
    with pytest.raises(ValueError, match="size"):
        io.write_grid(cells, str(tmp_path / "h"), ["band"], grid=Grid(0, 0, 1, 1))


def test_overlap_mask_regrids_an_unlike_grid(spark):
    a = spark.range(64).select((F.col("id") / 8).cast("int").alias("row_i"), (F.col("id") % 8).cast("int").alias("col_i"), F.lit(1.0).alias("value"))
    b = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 1, 2.0)], "row_i int, col_i int, value double")
    got = {(r.row_i, r.col_i) for r in algebra.mask_by_overlap(a, b, Grid(0, 8, 1, 1, 8, 8), Grid(2, 6, 2, 2, 2, 2)).collect()}
    assert got == {(r, k) for r in (2, 3) for k in (2, 3)} | {(r, k) for r in (4, 5) for k in (4, 5)}
    same = algebra.mask_by_overlap(a, b, Grid(0, 8, 1, 1, 8, 8), Grid(0, 8, 1, 1, 2, 2))
    assert {(r.row_i, r.col_i) for r in same.collect()} == {(0, 0), (1, 1)}


def test_regrid_between_reference_systems(spark):
    metric = Grid(0.0, 1_000_000.0, 100_000.0, 100_000.0, 10, 10, "EPSG:3857")
    source = spark.range(100).select((F.col("id") / 10).cast("int").alias("row_i"), (F.col("id") % 10).cast("int").alias("col_i"), F.col("id").cast("double").alias("v"))
    target = spark.createDataFrame([(1, 0.5, 0.5), (2, 4.0, 8.0), (3, -1.0, 1.0)], "id long, x double, y double")
    got = {r.id: r.value for r in regrid.onto(target, source, "v", metric).collect()}
    place = lambda lon, lat: (int((1e6 - 6378137 * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))) // 1e5), int(6378137 * np.radians(lon) // 1e5))
    assert got == {1: place(0.5, 0.5)[0] * 10.0 + place(0.5, 0.5)[1], 2: place(4, 8)[0] * 10.0 + place(4, 8)[1], 3: None}
    with pytest.raises(ValueError, match="closed form"):
        regrid.onto(target, source, "v", metric, "EPSG:27700")


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_near_mean_equals_brute_force_over_tile_rims(spark, tile):
    rng = random.Random(tile)
    rows = [(i, rng.randrange(-7, 8), rng.randrange(-7, 8), rng.choice([None, None, rng.random()])) for i in range(150)]  # sparse, some places twice
    rows += [(150, None, 0, 5.0), (151, 0, None, None), (152, None, None, None), (153, 400, 400, None)]
    cells = spark.createDataFrame(rows, "cell_id long, row_i int, col_i int, v double")
    got = {r.cell_id: r.near for r in regrid.with_near_mean(cells, "v", tile=tile).collect()}
    assert len(got) == len(rows)
    for i, r, k, _ in rows:
        met = [(w, v) for _, r2, k2, v in rows if None not in (r, k, r2, k2, v) and max(abs(r - r2), abs(k - k2)) == 1 for w in [math.hypot(r - r2, k - k2)]]
        want = sum(v / w for w, v in met) / sum(1 / w for w, _ in met) if met else None
        assert got[i] == (pytest.approx(want) if met else None)


def test_near_mean_of_an_empty_table_and_its_columns(spark):
    cells = spark.createDataFrame([], "cell_id long, row_i int, col_i int, v double, near_by string")
    out = regrid.with_near_mean(cells, "v", "mean_near")
    assert out.columns == [*cells.columns, "mean_near"] and out.count() == 0
