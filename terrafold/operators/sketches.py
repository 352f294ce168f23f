"""Mergeable sketches of a layer: quantiles and distinct counts of any region or span of bands from a small table.

A table of sketches is built once, a row for each key (a tile and a band, say); later questions merge its rows and never
read the layer again. The exact operators of ``ranks`` and ``algebra`` stay the default: sketches are for many questions
over one large layer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches, and the logarithm of the registers of the distinct counts.
SIZE, REGISTERS = 2000, 14


def rank_error(size: int = SIZE) -> float:
    """The error of a quantile's rank, as a share of the rows, that 99 of 100 answers stay under (the sketch's published bound)."""
    return 2.446 / size**0.943


def distinct_error(registers: int = REGISTERS) -> float:
    """Three standard errors of a distinct count, as a share."""
    return 3 * 1.04 / (1 << registers) ** 0.5


def sketch(df: DataFrame, value: str, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """(by, n, low, high, total, quantiles, distinct) of the valid values of each key; keys without one have no row."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"),
        F.kll_sketch_agg_double(v, size).alias("quantiles"), F.hll_sketch_agg(v.cast("string"), REGISTERS).alias("distinct"),
    )


def merged(table: DataFrame, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """The table by fewer keys; what is merged may be merged again."""
    return table.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("quantiles", size).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    ).where("n > 0")


def answers(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Keys with n, low, high, mean, distinct (estimated) and q, the quantiles in the order of ``shares``."""
    asked = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(s))) for s in shares]
    return table.withColumns({"mean": F.col("total") / F.col("n"), "q": F.array(*asked), "distinct": F.hll_sketch_estimate("distinct")}).drop("total", "quantiles")


def profile(table: DataFrame, classes: int = 20) -> DataFrame:
    """n, low, high, distinct (estimated) and whether the values are few enough to be classes, by the table's keys."""
    out = table.withColumn("distinct", F.hll_sketch_estimate("distinct"))
    return out.withColumn("categorical", F.col("distinct") <= classes).drop("total", "quantiles")
