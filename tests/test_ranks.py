"""Quantiles and weighted medians against plain sorting, where brackets are narrow and ties, hot groups and gaps occur."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import algebra, ranks

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    out = [("hot", draw.gauss(0, 5)) for _ in range(6000)] + [("ties", float(draw.randrange(4))) for _ in range(900)]
    out += [("one", 3.5), (None, 1.0), (None, 2.0), ("empty", None)] + [("hot", None)] * 50 + [("tail", draw.random() ** -9) for _ in range(700)]
    draw.shuffle(out)
    return out, spark.createDataFrame(out, "k string, v double").repartition(5).persist()


@pytest.mark.parametrize("accuracy", [100, 10_000])
@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles_equal_sorting(rows, accuracy, discrete):
    plain, df = rows
    got = {r.k: r.q for r in ranks.quantiles(df, "v", SHARES, ["k"], discrete, accuracy).collect()}
    assert set(got) == {"hot", "ties", "one", None, "tail"}
    for k, q in got.items():
        mine = np.array([v for key, v in plain if key == k and v is not None])
        assert q == pytest.approx(np.quantile(mine, SHARES, method="inverted_cdf" if discrete else "linear"), rel=1e-12)


def test_quantiles_without_keys(spark, rows):
    plain, df = rows
    want = np.quantile([v for _, v in plain if v is not None], SHARES)
    assert ranks.quantiles(df, "v", SHARES, accuracy=200).first().q == pytest.approx(want, rel=1e-12)
    nothing = spark.createDataFrame([(1, None), (2, None)], "k int, v double")
    assert [r.q for r in ranks.quantiles(nothing, "v", [0.5]).collect()] == [[]]
    assert ranks.quantiles(nothing, "v", [0.5], ["k"]).count() == 0
    for df in (nothing, nothing.where("false")):
        assert algebra.percentile_clip(df, "v").count() == algebra.quantile_bins(df, "v", 4).count() == algebra.value_format(df, "v").count() == df.count()


@pytest.mark.parametrize("slices", [2, 64])
def test_weighted_median_equals_running_sums(spark, rows, slices):
    plain, _ = rows
    weighted = [(k, v, i % 7 if i % 11 else None) for i, (k, v) in enumerate(plain)]
    df = spark.createDataFrame(weighted, "k string, v double, w int").repartition(3)
    got = {r.k: r["median"] for r in ranks.weighted_median(df, "k", "v", "w", slices).collect()}
    want = {}
    for k in {k for k, _, _ in weighted}:
        mine = sorted((v, w) for key, v, w in weighted if key == k and v is not None and w is not None)
        run, half = 0, sum(w for _, w in mine) / 2
        for v, w in mine:
            run += w
            if run >= half:
                want[k] = v
                break
    # Within equal values the order of weights does not matter, for the first value to reach the half is the same.
    assert got == want


def test_brackets_leave_little_to_order(spark):
    df = spark.range(200_000).withColumn("v", (F.col("id") * 7919 % 200_003).cast("double"))
    plan = ranks.quantiles(df, "v", [0.5])
    assert plan.first().q[0] == df.selectExpr("median(v)").first()[0]
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
