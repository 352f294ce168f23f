"""Golden values and the rules that differ on purpose."""

import pytest
from pyspark.sql import functions as F

from terrafold.functions import formulas
from terrafold.operators import algebra, carbon, crop, regrid, spatial
from terrafold.sources import layers


def soil(spark, sand=30.0, n=2, **more):
    row = {"cell_id": 1, "clay": 25.0, "soc0": 40.0, "sand": sand, "n_years": n, "tmp": [15.0] * 12, "water": [80.0] * 12,
           "evap": [20.0] * 12, "pc": [1.0] * 12, "c_inp": [0.0] * 12, "fym": [0.0] * 12} | more
    kinds = "cell_id int, clay double, soc0 double, sand double, n_years int, tmp array<double>, water array<double>, evap array<double>, pc array<double>, c_inp array<double>, fym array<double>"
    return spark.createDataFrame([tuple(row.values())], kinds)


def test_conventional_run(spark):
    got = carbon.annual(soil(spark), ["cell_id"]).orderBy("year").collect()
    assert [r.soc for r in got] == pytest.approx([40, 37.534622, 35.909515], abs=1e-5)
    assert [r.co2 for r in got] == pytest.approx([0, 2.465377, 1.6251065], abs=1e-5)


def test_reduced_tillage_run(spark):
    got = carbon.reduced_tillage(soil(spark), ["cell_id"]).orderBy("year").collect()
    assert [r.soc for r in got] == pytest.approx([40, 37.60099, 36.023407], abs=1e-5)
    assert [r.co2 for r in got] == pytest.approx([0, 2.3990104, 1.5775822], abs=1e-5)


def test_mass_balance_and_long_drivers(spark):
    got = carbon.annual(soil(spark, n=5, c_inp=[0.3] * 12), ["cell_id"]).orderBy("year").collect()
    assert got[-1].soc + sum(r.co2 for r in got) == pytest.approx(40 + 5 * 12 * 0.3)
    long = soil(spark, n=2, tmp=[15.0] * 24, water=[80.0] * 24, evap=[20.0] * 24, pc=[1.0] * 24, c_inp=[0.0] * 24, fym=[0.0] * 24)
    assert carbon.annual(long, ["cell_id"]).where("year = 2").first().soc == pytest.approx(35.909515, abs=1e-5)


def test_blocks_equal_the_fold(spark):
    df = soil(spark, n=4, c_inp=[0.2] * 12, fym=[0.1] * 12, pc=[0.0, 1.0] * 6, evap=[90.0] * 12).unionByName(soil(spark, n=2, sand=36.0)).unionByName(soil(spark, n=1, clay=None))
    for modifier in (None, formulas.tillage_modifier):
        a, b = ([tuple(r) for r in f(df, ["cell_id", "n_years"], modifier=modifier).orderBy("n_years", "year").collect()] for f in (carbon.annual, carbon.annual_blocks))
        assert len(a) == 10 and [x[:3] for x in a] == [x[:3] for x in b]
        assert [v for x in a for v in x[3:5] if v is not None and x[1] > 1] == pytest.approx([v for x in b for v in x[3:5] if v is not None and x[1] > 1])
    assert carbon.annual_blocks(df.limit(0), ["cell_id"]).count() == 0


def test_tillage_modifiers(spark):
    rows = spark.createDataFrame([(10.0,), (36.0,), (38.0,), (20.0,), (None,)], "sand double")
    got = rows.select(*[formulas.tillage_modifier(F.col("sand"), p) for p in carbon.POOLS]).collect()
    other = (0.72, 0.97, 0.99, 0.94)
    assert [tuple(r) for r in got] == [other, (1.54, 2.15, 2.38, 2.93), other, other, other]


def season(spark, **more):
    row = {"zone_group": "z", "crop": "c", "k_ini": 0.5, "k_mid": 1.1, "k_late": 0.8, "d_ini": 2, "d_dev": 3, "d_mid": 4, "d_late": 2, "plant_day": 74} | more
    return spark.createDataFrame([tuple(row.values())], "zone_group string, crop string, k_ini double, k_mid double, k_late double, d_ini int, d_dev int, d_mid int, d_late int, plant_day int")


def days(spark):
    d = spark.range(1, 366).select(F.col("id").cast("int").alias("day_num"))
    return d.withColumn("month", formulas.month_of_day(F.col("day_num")))


def test_stage_lengths_and_rejection(spark):
    kc = crop.daily_kc(season(spark), days(spark))
    counts = {r.stage: r["count"] for r in kc.groupBy("stage").count().collect()}
    assert [counts[s] for s in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 2]
    late = season(spark, plant_day=360)
    assert crop.rejected_crops(late).count() == 1 and crop.valid_crops(late).count() == 0
    with pytest.raises(Exception, match="beyond day 365"):
        crop.valid_crops(late, strict=True).collect()


def test_cold_year_has_no_demand(spark):
    cold = spark.createDataFrame([(1, m, -5.0, 45.0) for m in range(1, 13)], "cell_id int, month int, tmp double, y double")
    months = spark.createDataFrame([(m, 30) for m in range(1, 13)], "month int, n_days int")
    assert {r.pet for r in crop.location_pet(cold, months).collect()} == {0.0}
    with pytest.raises(Exception, match="twelve temperatures"):
        crop.location_pet(cold.where("month < 12"), months).collect()


def test_grid_mismatch_and_missing_lookup(spark, tmp_path):
    with pytest.raises(ValueError, match="must match raster dimensions"):
        algebra.same_grid({"nrows": 1}, {"nrows": 2})
    with pytest.raises(FileNotFoundError, match="crop table.*absent"):
        layers.lookup_csv(spark, f"file://{tmp_path}/absent.csv", "a int", "crop table").collect()


def test_missing_values_are_never_valid(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-9999.0,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(formulas.finite(F.col("v"), -9999.0)).collect()] == [None, None, None, None, 2.0]
    assert rows.where("v is null").select(algebra.binarize(F.col("v"))).first()[0] == 255


def test_scaled_residues_and_unknown_crop(spark):
    p = {n: F.lit(v).cast("double") for n, v in {"dry": 0.9, "rs": 0.2, "r_ag": None, "r_t": None, "slope": 1.0, "intercept": -5.0}.items()}
    out = formulas.residues(F.lit(2.0), p, scaled=True)
    assert tuple(spark.range(1).select(out["abg"], out["bg"], out["res"]).first()) == (None, None, 0.0)
    with pytest.raises(ValueError, match="unknown crop"):
        crop.residues(spark.range(1).selectExpr("id cell_id", "1.0D yield"), spark.createDataFrame([], "crop string"), "Rice")


def test_holes_and_multiparts_by_even_odd(spark):
    square = lambda part, lo, hi: [(1, part, i, x, y) for i, (x, y) in enumerate([(lo, lo), (hi, lo), (hi, hi), (lo, hi)])]
    rings = spark.createDataFrame([*square(0, 0.0, 9.0), *square(1, 3.0, 6.0)], "poly_id int, part int, seq int, x double, y double")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 4.5, 4.5), (3, 20.0, 1.0), (4, None, 1.0)], "p int, x double, y double")
    for size in (1.0, 8.0):
        assert [r.p for r in spatial.point_in_polygon(points, rings, "p", size).collect()] == [1]


def test_nearest_valid_ties_and_far_holes(spark):
    cells = spark.createDataFrame([(0, 0, 0, 5.0), (1, 0, 1, None), (2, 0, 2, 7.0), (3, 40, 40, None)], "cell_id int, row_i int, col_i int, v double")
    assert {r.cell_id: r.value for r in regrid.nearest_valid(cells, "v").collect()} == {0: 5.0, 1: 5.0, 2: 7.0, 3: 7.0}


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,), (None,)], "v double")
    assert [r.bin for r in algebra.quantile_bins(df, "v", 4).collect()][-1] is None
    assert algebra.histogram(df.where("v = 1"), "v").collect()[0].n == 3


def test_frames_and_cycles_that_do_not_fit_raise(spark):
    from pyspark.sql import functions as F

    from terrafold.operators import carbon

    cells = spark.createDataFrame([(r, k, 10.5 + k, 39.5 - r, 1.0) for r in range(3) for k in range(4)], "row_i int, col_i int, x double, y double, value double")
    frame = algebra.frame_of(cells, 1.0)
    assert frame == {"crs": "EPSG:4326", "dx": 1.0, "dy": 1.0, "x0": 10.0, "y0": 40.0, "nrows": 3, "ncols": 4}
    layer = cells.select((F.col("row_i") * 4 + F.col("col_i")).alias("cell_id"), "value")
    with pytest.raises(ValueError, match="must match raster dimensions"):
        algebra.grid_product([layer, layer], [frame, frame | {"x0": 11.0}])
    with pytest.raises(ValueError, match="at least one"):
        algebra.grid_product([])
    with pytest.raises(ValueError, match="reference system"):
        algebra.grid_difference(cells, cells, frame, frame | {"crs": "EPSG:3857"})
    with pytest.raises(ValueError, match="no closed form"):
        algebra.pixel_centre(F.lit(0), F.lit(0), 0.0, 0.0, 1.0, "EPSG:32633")
    north = algebra.grid_difference(cells, cells, frame, frame | {"y0": 42.0, "x0": 9.0})
    assert {(r.row_i, r.col_i) for r in north.where("value is null").collect()} >= {(-2, -1), (2, 3)} and north.count() == 5 * 5
    months = lambda n: spark.createDataFrame([(1, m, float(m)) for m in range(1, n + 1)], "cell_id long, month int, v double")
    assert [r.v for r in algebra.tile_years(months(12), 2).orderBy("t").collect()] == [float(m) for m in range(1, 13)] * 2
    assert [(r.year, r.month, r.v) for r in algebra.tile_years(months(24), 2).orderBy("t").collect()][12] == (2, 1, 13.0)
    with pytest.raises(Exception, match="12 or 12"):
        algebra.tile_years(months(13), 2).collect()
    odd = spark.sql("select 1 as cell_id, 20D as clay, 30D as sand, 50D as soc0, 2 as n_years").withColumns({d: F.array_repeat(F.lit(1.0), 13) for d in carbon.DRIVERS})
    with pytest.raises(Exception, match="12 or 12"):
        carbon.annual(odd, ["cell_id"]).collect()


def test_value_profile_of_many_values_has_no_boundaries(spark):
    many, few = spark.range(50).withColumnRenamed("id", "v"), spark.createDataFrame([(1.0,), (2.0,), (4.0,), (4.0,), (None,)], "v double")
    assert algebra.value_profile(many, "v").first().boundaries is None
    got = algebra.value_profile(few, "v").first()
    assert (got.n, got.categorical, got.boundaries) == (3, True, [1.5, 3.0])
    assert algebra.value_profile(few.limit(0), "v").first().boundaries == []
