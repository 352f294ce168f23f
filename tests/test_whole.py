"""Whole jobs that have no SQL, against the plain operators on a few cells."""

import pytest
from pyspark.sql import functions as F

from terrafold.functions import formulas
from terrafold.operators import algebra, carbon, crop
from terrafold.plans import queries as q
from terrafold.plans.fixtures import Layers

SF = "/root/testdata/sf0.001"


def test_scenarios_run_for_their_own_years(spark):
    layers = Layers(spark, SF)
    years = {r.scenario: r for r in layers.scenarios.collect()}
    got = q.WHOLE["run_carbon_scenarios_whole"](spark, SF).persist()
    cells = layers.cells.where("lu = 1")
    for r in got.groupBy("scenario").agg(F.max("year").alias("last"), F.count(F.lit(1)).alias("n")).collect():
        assert (r["last"], r.n) == (years[r.scenario].n_years, cells.count() * (years[r.scenario].n_years + 1))
    few = cells.where("cell_id < 5")
    for name, s in years.items():
        water = F.col("rain") + (crop.irrigation_need(F.col("evap"), F.col("rain")) if s.irrigated else 0.0)
        rows = layers.monthly.join(few.select("cell_id"), "cell_id").withColumn("water", water).withColumn("c_inp", F.col("c_inp") * float(s.residues))
        packed = carbon.pack(rows, ["cell_id"], ["tmp", "water", "evap", "pc", "c_inp", "fym"]).join(few.select("cell_id", "clay", "sand", "soc0"), "cell_id")
        want = carbon.annual(packed.withColumn("n_years", F.lit(s.n_years)), ["cell_id"], modifier=formulas.tillage_modifier if s.red_till else None)
        want = {(r.cell_id, r.year): r.soc for r in want.collect()}
        assert {(r.cell_id, r.year): r.soc for r in got.where("cell_id < 5").where(F.col("scenario") == name).collect()} == pytest.approx(want, abs=1e-4)


def test_scenario_report_has_four_parts(spark):
    runs = q.scenario_rows(Layers(spark, SF)).withColumnRenamed("soc", "value").persist()
    got = q.WHOLE["scenario_report_whole"](spark, SF).persist()
    assert {r.part for r in got.select("part").distinct().collect()} == {"series", "change", "benefit", "zonal"}
    one, two = (runs.where(F.col("scenario") == n) for n in ("irr_resoff_convt", "rf_resoff_redt"))
    want = {r.cell_id: r.benefit for r in algebra.practice_benefit(one, two, 34, 34).collect()}
    rows = got.where("part = 'benefit' and scenario = 'irr_resoff_convt' and other = 'rf_resoff_redt'").collect()
    assert {r.year for r in rows} == {34} and {r.cell_id: r.value for r in rows} == pytest.approx(want, abs=1e-4)
    owners = q.polygons_of_cells(Layers(spark, SF))
    last = runs.where("scenario = 'rf_resoff_convt' and year = 54").join(owners, "cell_id").groupBy("poly_id").agg(F.avg("value").alias("v"))
    rows = got.where("part = 'zonal' and scenario = 'rf_resoff_convt' and measure = 'cf'").collect()
    assert {r.poly_id: r.value for r in rows} == pytest.approx({r.poly_id: r.v for r in last.collect()}, abs=1e-4)
    assert got.where("part = 'series' and measure = 'mean'").count() == 35 + 55 + 35 + 11
