"""Merged sketches within their stated errors, and boxes of a grid in few files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import ranks, sketches
from terrafold.sources import clustered


def test_merged_sketches_stay_within_their_errors(spark):
    rows = spark.range(200_000).select((F.col("id") % 40).alias("tile"), (F.col("id") % 3).alias("band"), (F.rand(5) * F.rand(6) * 1000).alias("v")).persist()
    rows = rows.withColumn("v", F.when(F.col("tile") != 7, F.col("v")))
    table = sketches.sketch(rows, "v", ["tile", "band"])
    assert table.where("tile = 7").isEmpty()
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    twice = sketches.merged(sketches.merged(table, ["band"]), [])
    for got in (sketches.answers(sketches.merged(table), shares).first(), sketches.answers(twice, shares).first()):
        values = np.sort([r.v for r in rows.where("v is not null").select("v").collect()])
        ranks_of = np.searchsorted(values, got.q) / len(values)
        assert np.abs(ranks_of - shares).max() <= sketches.rank_error() and got.n == len(values)
        assert got["distinct"] == pytest.approx(len(set(values)), rel=sketches.distinct_error())
        assert got["mean"] == pytest.approx(values.mean()) and (got.low, got.high) == (values[0], values[-1])
    exact = {r.band: r.q for r in ranks.quantiles(rows, "v", [0.5], ["band"]).collect()}
    near = {r.band: r.q for r in sketches.answers(sketches.merged(table, ["band"]), [0.5]).collect()}
    assert set(exact) == set(near) and all(near[b][0] == pytest.approx(exact[b][0], rel=0.05) for b in exact)
    few = sketches.profile(sketches.merged(sketches.sketch(rows.withColumn("v", F.col("band") * 1.0), "v", ["tile"])))
    assert (few.first()["distinct"], few.first().categorical) == (3, True)
    assert sketches.merged(sketches.sketch(rows.limit(0), "v", ["tile"])).count() == 0


def test_a_box_is_read_from_few_files(spark, tmp_path):
    cells = spark.range(400 * 400).select((F.col("id") / 400 - 100).cast("int").alias("row_i"), (F.col("id") % 400).cast("int").alias("col_i"), F.col("id").alias("cell_id"))
    path = str(tmp_path / "grid")
    clustered.write_clustered(cells, path, 400)
    box = clustered.read_box(spark, path, (20, 59), (130, 169))  # a hundredth of the grid
    want = cells.where("row_i between 20 and 59 and col_i between 130 and 169")
    assert sorted(r.cell_id for r in box.collect()) == sorted(r.cell_id for r in want.collect())
    every = len(spark.read.parquet(path).inputFiles())
    assert every > 300 and len(box.inputFiles()) < 0.05 * every
    assert clustered.read_box(spark, path, (5000, 5001), (0, 1)).count() == 0


def test_the_curve_interleaves_and_keeps_negatives_apart(spark):
    at = [(r, k) for r in (-5, -1, 0, 1, 7) for k in (-3, 0, 2, 100_000)]
    df = spark.createDataFrame(at, "r int, k int").withColumn("z", clustered.curve(F.col("r"), F.col("k")))

    def plain(r, k):
        half = clustered.REACH // 2
        return sum((((r + half) >> b & 1) << (2 * b + 1)) | (((k + half) >> b & 1) << (2 * b)) for b in range(32))

    assert {(r.r, r.k): r.z for r in df.collect()} == {(r, k): plain(r, k) for r, k in at}
