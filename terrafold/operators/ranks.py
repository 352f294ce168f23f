"""Exact quantiles and weighted medians without a buffer that holds a whole group.

A bounded sketch brackets every wanted rank, rows under the bracket are only counted, and what lies in the bracket is
counted by value before it is ordered. So a group's hottest task sorts a small share of the group, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is the group's size over this; brackets reach four such errors to both sides.
ACCURACY = 10_000
#: Value ranges of a group in the weighted median.
SLICES = 64


def beside(rows: DataFrame, groups: DataFrame, by: Sequence[str], few: bool = False) -> DataFrame:
    """Rows with their group's columns (a missing key is a group too); without keys one row is broadcast.

    ``few`` groups are broadcast too: the planner takes a grouping for as large as its rows, and would shuffle these.
    """
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    named = groups.withColumnsRenamed({k: f"_of_{k}" for k in by})
    named = F.broadcast(named) if few else named
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by]).drop(*[f"_of_{k}" for k in by])


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), discrete: bool = False, accuracy: int = ACCURACY, few: bool = False) -> DataFrame:
    """(by, q): the quantiles of each group's valid values as an array in the order of ``shares``.

    Interpolated between neighbours, or with ``discrete`` the first value whose rank reaches the share. Groups without a
    valid value have no row; without ``by`` there is one row, with an empty array if nothing is valid. Ask with ``F.get``.
    ``df`` is read twice; it is not shuffled for it if its groups are ``few``. The bracket of a group of at most ``accuracy`` rows is the whole group.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    reach = 4 / accuracy
    cuts = [min(max(s + side * reach, 0.0), 1.0) for s in shares for side in (-1, 1)]
    ends = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", cuts, accuracy).alias("_cut")
    )

    def bracket(i: int, share: float) -> Column:
        at = F.greatest(F.ceil(share * F.col("_n")) - 1, F.lit(0)).cast("double") if discrete else share * (F.col("_n") - 1)
        few = F.col("_n") <= accuracy  # four sketch errors are then less than the ranks that rounding moves
        low = F.col("_low") if share <= reach else F.when(few, F.col("_low")).otherwise(F.get("_cut", F.lit(2 * i)))
        high = F.col("_high") if share >= 1 - reach else F.when(few, F.col("_high")).otherwise(F.get("_cut", F.lit(2 * i + 1)))
        return F.struct(F.lit(i).alias("i"), at.alias("at"), low.alias("low"), high.alias("high"))

    ends = ends.select(*by, F.array(*[bracket(i, s) for i, s in enumerate(shares)]).alias("_brackets"))
    near = beside(rows, ends, by, few).select(*by, "_v", F.explode("_brackets").alias("_b")).where("_v <= _b.high")
    place = F.when(F.col("_v") >= F.col("_b.low"), F.col("_v"))  # all that lies under the bracket is one place
    held = near.groupBy(*by, F.col("_b.i").alias("_i"), F.col("_b.at").alias("_at"), place.alias("_place")).agg(F.count(F.lit(1)).alias("_rows"))
    run = held.withColumn("_run", F.sum("_rows").over(Window.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_place"))))
    first = lambda rank: F.min(F.when(F.col("_run") > rank, F.col("_place")))
    found = run.groupBy(*by, "_i", "_at").agg(
        first(F.floor("_at")).alias("_a"), first(F.ceil("_at")).alias("_z"), F.max(F.when(F.col("_place").isNull(), F.col("_rows"))).alias("_under")
    )
    missed = F.col("_z").isNull() | (F.coalesce("_under", F.lit(0)) > F.floor("_at"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_z")
    q = F.when(missed, F.raise_error(F.lit("the sketch missed a rank: use a smaller accuracy")).cast("double")).when(F.col("_a") == F.col("_z"), F.col("_a"))
    listed = F.sort_array(F.collect_list(F.struct("_i", q.otherwise(between).alias("_q"))))
    return found.groupBy(*by).agg(F.transform(listed, lambda s: s["_q"]).alias("q"))


def weighted_median(rows: DataFrame, group: str, value: str, weight: str, slices: int = SLICES) -> DataFrame:
    """(group, median): the first value whose running weight reaches half of the group's total.

    Weights are summed by value, then by range of values; only the range in which the half is reached is ordered.
    """
    valid = rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    sums = valid.groupBy(group, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    cuts = sums.groupBy(group).agg(F.percentile_approx("_v", [i / slices for i in range(1, slices)], ACCURACY).alias("_cuts"))
    sums = beside(sums, cuts, [group]).select(group, "_v", "_w", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_slice"))
    w = Window.partitionBy(group)
    parts = sums.groupBy(group, "_slice").agg(F.sum("_w").alias("_part"))
    parts = parts.withColumns({"_upto": F.sum("_part").over(w.orderBy("_slice")), "_half": F.sum("_part").over(w) / 2})
    hit = parts.where(F.col("_upto") >= F.col("_half")).groupBy(group).agg(
        F.min("_slice").alias("_slice"), F.min_by(F.col("_upto") - F.col("_part"), "_slice").alias("_before"), F.first("_half").alias("_half"),
    )
    inside = beside(sums, hit, [group, "_slice"]).withColumn("_run", F.col("_before") + F.sum("_w").over(w.orderBy("_v")))
    # Rounding may leave the last running weight a little under the range's own sum.
    reached = F.min(F.when(F.col("_run") >= F.col("_half"), F.col("_v")))
    return inside.groupBy(group).agg(F.coalesce(reached, F.max("_v")).alias("median"))
