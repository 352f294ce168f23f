"""Plans whose shuffles and passes must not multiply with months and scenarios."""

import re

import pytest
from pyspark.sql import functions as F

from terrafold.operators import algebra, carbon
from terrafold.plans import queries as q
from terrafold.plans.fixtures import Layers

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """The keys of each shuffle in a plan, without ids."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_months_are_packed_by_one_shuffle_of_the_line_items(spark):
    L = Layers(spark, SF)
    for df in (L.monthly, q.packed(L), q.scenario_rows(L), q.scenario_rows(L, 2)):
        assert exchanges(df) == ["cell_id", "cell_id"]  # the cells and the line items; none by month or scenario


def test_blocks_with_soil_water_that_settles_late_or_never(spark):
    """Rows keep their decay once the soil water repeats; drift over years and a table of unlike rows must not matter."""
    drift = "transform(sequence(1, 12), m -> cast(3.0 + 0.05 * (id % 7) + m % 3 as double))"
    long = "transform(sequence(1, 12 * n_years), m -> cast(2.0 + id % 5 + m % 17 as double))"
    rows = spark.range(40).selectExpr("id", "cast(3 + id % 4 * 5 as int) AS n_years", "cast(10 + id as double) AS clay", "30.0D AS sand", "cast(40 + id as double) AS soc0")
    one = rows.selectExpr("*", f"{drift} AS water", "transform(sequence(1, 12), m -> cast(4.0 + m % 2 as double)) AS evap")
    two = rows.selectExpr("id + 40 AS id", "n_years", "clay", "sand", "soc0", f"{long} AS water", "transform(sequence(1, 12 * n_years), m -> cast(5 + m % 4 as double)) AS evap")
    df = one.unionByName(two)
    year = lambda e: F.transform("evap", lambda v, i: F.expr("cast(0 as double)") + e(i))
    df = df.withColumns({"tmp": year(lambda i: i % 12 * 2.0), "pc": year(lambda i: F.when(F.col("id") % 3 == 0, i % 2).otherwise(1)), "c_inp": year(lambda i: 0.1 * (i % 5)), "fym": year(lambda i: 0.02 * (i % 3))})
    a, b = ({(r.id, r.year): (r.soc, r.co2) for r in f(df, ["id"]).collect()} for f in (carbon.annual, carbon.annual_blocks))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], abs=1e-9) for k in a)


def test_benefit_joins_one_fold_and_broadcasts_no_cells(spark):
    plan = q.QUERIES["practice_benefit"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "lineitem" not in plan  # both sides read the one fold


def test_report_shuffles_no_row_for_a_change_or_a_quartile(spark):
    runs = spark.range(200).selectExpr("concat('s', id % 2) AS label", "cast(id % 3 as int) AS year", "cast(id as double) AS value")
    plan = algebra.timeseries(runs)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
    got = q.WHOLE["scenario_report_whole"](spark, SF)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and not re.search(r"Window .*first\(value", text)
