"""Look-ups that tell what they lack: unknown keys raise, or are counted, in the pass that joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def join_checked(rows: DataFrame, table: DataFrame, on: list[str], what: str, seen: Observation | None = None) -> DataFrame:
    """Rows left-joined with a lookup; a key that the lookup lacks raises when it is reached, and names itself.

    With an observation, unknown keys stay with NULLs and are counted instead: ``unknown`` and ``first``, the least one,
    are there once an action has run. A key with a NULL part is no key. Nothing is read twice and no job runs before.
    """
    joined = rows.join(table.withColumn("_known", F.lit(True)), on, "left")
    unknown = F.col("_known").isNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    key = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
    if seen is not None:
        joined = joined.observe(seen, F.count_if(unknown).alias("unknown"), F.min(F.when(unknown, key)).alias("first"))
    else:
        joined = joined.where(F.when(unknown, F.raise_error(F.concat(F.lit(f"unknown {what}: "), key)).cast("boolean")).otherwise(True))
    return joined.drop("_known")


def guarded(rows: DataFrame, table: DataFrame, column: str, wanted: str, what: str) -> DataFrame:
    """The same rows; if a lookup has none of one name, the action that reads them raises with the name.

    The lookup is asked for one row of the name beside the rows, in their own job.
    """
    held = F.broadcast(table.where(F.col(column) == wanted).limit(1).agg(F.count(F.lit(1)).alias("_held")))
    known = F.when(F.col("_held") == 0, F.raise_error(F.lit(f"unknown {what}: {wanted}")).cast("boolean")).otherwise(True)
    return rows.crossJoin(held).where(known).drop("_held")
