"""Resumable batches, checked look-ups, deleted scratch tables and sources that say what is wrong."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from terrafold.operators import crop, lookups, prepare
from terrafold.plans import queries as q
from terrafold.plans.fixtures import Layers
from terrafold.sources import layers as io
from terrafold.sources.batch import Batch

SF = "/root/testdata/sf0.001"


def make(spark, calls, name, n=3):
    def run():
        calls.append(name)
        return spark.range(n)

    return run


def test_finished_steps_are_found_and_stale_ones_run(spark, tmp_path):
    calls, folder = [], str(tmp_path / "batch")

    def job(size, source="s"):
        b = Batch(spark, folder)
        one = b.step("one", make(spark, calls, "one", size), [source], size=size)
        two = b.step("two", make(spark, calls, "two"), [one])
        assert one.df.count() == size and two.df.count() == 3
        return b

    assert job(5).started == ["one", "two"]
    assert job(5).started == [] and calls == ["one", "two"]
    assert job(6).started == ["one", "two"]  # another parameter: it and what follows from it
    assert job(6, "t").started == ["one", "two"]  # another state of the source
    assert job(5).started == []
    gone = job(6, "t").prune()
    assert len(gone) == 4 and job(6, "t").started == [] and job(5).started == ["one", "two"]


def test_half_written_outputs_do_not_pass(spark, tmp_path):
    calls, folder = [], str(tmp_path / "batch")
    first = Batch(spark, folder)
    step = first.step("one", make(spark, calls, "one"))
    path = first.done[step.key]
    os.remove(f"{path}/_SUCCESS")
    assert Batch(spark, folder).step("one", make(spark, calls, "one")).df.count() == 3 and calls == ["one", "one"]

    def broken():
        return spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))

    b = Batch(spark, folder)
    with pytest.raises(Exception, match="broken"):
        b.step("bad", broken)
    assert Batch(spark, folder).step("bad", make(spark, calls, "bad")).df.count() == 3

    target = str(tmp_path / "kept")
    os.makedirs(target)
    (tmp_path / "kept" / "part-0.parquet").write_bytes(b"half")
    assert io.write_if_absent(spark.range(2), target).count() == 2
    assert io.write_if_absent(spark.range(9), target).count() == 2 and io.write_if_absent(spark.range(9), target, renew=True).count() == 9


def test_source_key_follows_its_files(spark, tmp_path):
    b, path = Batch(spark, str(tmp_path / "b")), str(tmp_path / "data")
    spark.range(3).write.parquet(path)
    before = b.source(path)
    assert b.source(path) == before
    spark.range(1).write.mode("append").parquet(path)
    assert b.source(path) != before


def test_scenarios_share_steps_and_resume(spark, tmp_path):
    L = Layers(spark, SF)
    cells = q.owned(L).join(L.cells.select("cell_id", "y", "zone_id"), "cell_id").persist()
    held = prepare.CropLayers(cells, L.monthly.persist(), L.spam, L.country_yield, L.crops, L.zones, L.days, L.months, L.residues, "k")
    rows = spark.createDataFrame([("a", "Maize", None), ("b", "Maize", "irr"), ("c", "Maize", "rf")], "scenario string, crop string, technology string")
    folder = str(tmp_path / "crops")
    b = Batch(spark, folder)
    prepare.run_scenarios(b, held, rows.where("scenario = 'b'"))
    assert sorted(b.started) == ["cover", "inputs", "irrigation", "pet", "residues", "yield"]
    b = Batch(spark, folder)
    out = prepare.run_scenarios(b, held, rows)
    assert sorted(b.started) == ["inputs"] * 2 + ["residues"] * 2 + ["yield"] * 2
    assert {r.scenario for r in out.select("scenario").distinct().collect()} == {"a", "b", "c"}
    b = Batch(spark, folder)
    assert prepare.run_scenarios(b, held, rows).count() == out.count() and b.started == []
    with pytest.raises(Exception, match="unknown crop: Maiz"):
        prepare.run_scenarios(Batch(spark, folder), held, spark.createDataFrame([("a", "Maiz", None)], "scenario string, crop string, technology string"))


def test_unknown_keys_raise_at_the_action_or_are_counted(spark):
    rows = spark.createDataFrame([(1, "Maize"), (2, "Mayze"), (3, None), (4, "Barly"), (5, "Barly")], "id long, crop string")
    table = spark.createDataFrame([("Maize", 1.0)], "crop string, k double")
    joined = lookups.join_checked(rows, table, ["crop"], "crop")
    with pytest.raises(Exception, match="unknown crop: (Mayze|Barly)"):
        joined.collect()
    assert {(r.id, r.k) for r in lookups.join_checked(rows.where("id in (1, 3)"), table, ["crop"], "crop").collect()} == {(1, 1.0), (3, None)}
    seen = Observation()
    assert lookups.join_checked(rows, table, ["crop"], "crop", seen).count() == 5
    assert seen.get == {"unknown": 3, "first": "Barly"}
    with pytest.raises(Exception, match="unknown crop: Mayze"):
        lookups.guarded(rows, table, "crop", "Mayze", "crop").collect()
    assert lookups.guarded(rows, table, "crop", "Maize", "crop").collect() == rows.collect()


def test_country_yields_and_residues_name_a_typo(spark):
    borders = spark.createDataFrame([(1, "A")], "poly_id long, name string")
    yields = spark.createDataFrame([("A", "Maize", 2.0, 0.5)], "area string, item string, avg_yield double, yld_ratio double")
    out = crop.country_yields(borders, yields, "Mais")
    with pytest.raises(Exception, match="unknown crop: Mais"):
        out.collect()
    assert crop.country_yields(borders, yields, "Maize").first().avg_yield == 2.0


def test_lookup_with_moved_columns_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Crop,Rate\nMaize,2\n", encoding="utf-8")
    assert io.lookup_csv(spark, str(tmp_path / "a.csv"), "Crop string, Rate int", "rates").collect() == [("Maize", 2)]
    (tmp_path / "b.csv").write_text("Rate,Crop\n2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.lookup_csv(spark, str(tmp_path / "b.csv"), "Crop string, Rate int", "rates").collect()


def test_written_tables_go_with_their_block(spark):
    with io.temporary(spark):
        with io.temporary(spark):
            inner = io.materialized(spark.range(3), "t").inputFiles()[0]
        outer = io.materialized(spark.range(3), "t").inputFiles()[0]
        assert not os.path.exists(inner.removeprefix("file://")) and os.path.exists(outer.removeprefix("file://"))
    assert not os.path.exists(outer.removeprefix("file://"))


def test_layers_of_cells_are_not_broadcast(spark, tmp_path):
    """Files of millions of cells pack under the planner's limit, so size on disk must not decide."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    L = Layers(spark, SF)
    assert "SortMergeJoin" in plan(L.cells.select("cell_id", "lu").join(L.spam.select("cell_id", "y_all"), "cell_id"))
    plans = {}

    class Noted(Batch):
        def step(self, name, make, *args, **kwargs):
            def noted():
                df = make()
                plans[name] = plan(df)
                return df

            return super().step(name, noted, *args, **kwargs)

    cells = q.owned(L).join(L.cells.select("cell_id", "y", "zone_id"), "cell_id").persist()
    held = prepare.CropLayers(cells, L.monthly.persist(), L.spam, L.country_yield, L.crops, L.zones, L.days, L.months, L.residues, "k")
    prepare.inputs_of(Noted(spark, str(tmp_path / "b")), held, "Maize", "irr")
    assert "Broadcast" not in plans["inputs"] and plans["inputs"].count("SortMergeJoin") == 4
    assert all("SortMergeJoin" in plans[n] for n in ("pet", "irrigation", "residues", "yield"))
