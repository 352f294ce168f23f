"""Best-fit packing into bins of several permitted capacities.

Documents are pieces with a length. Longer ones than the largest capacity are cut into full pieces and a rest. Pieces
are dealt to shards by hash, so each shard packs a bounded number of units; the shard count follows the summed length.
Within a shard, pieces go in falling order of length to the open bin with the least room left that holds them. The
capacities are optimised jointly: for every permitted floor, a bin opens at the smallest capacity that holds its first
piece and is at least the floor, all bins shrink to the smallest capacity that holds their contents at the end, and
the floor with the least summed capacity wins (the larger on a tie, which leaves fewer bins).

Defined results: null, zero and negative lengths give no piece, so such documents are absent; ties go by id, then
piece; repeated rows are distinct pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole, written

#: Permitted sequence lengths, and units (words) that one shard holds on average.
CAPACITIES = (512, 1024, 2048, 4096)
SHARD_UNITS = 400_000


def best_fit(lengths: list[int], capacities: tuple[int, ...], floor: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and what each bin holds; lengths fall and none exceeds the largest capacity."""
    opening = [c for c in capacities if c >= floor]
    room: list[tuple[int, int]] = []  # (room left, bin), sorted: the first entry with enough room fits best
    which, offset, used = [], [], []
    for size in lengths:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = opening[bisect_left(opening, size)], len(used)
            used.append(0)
        which.append(b)
        offset.append(used[b])
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return which, offset, used


def pack_lengths(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], np.ndarray]:
    """The best of all floors: bin and offset of each length, and the final capacity of each bin."""
    best = None
    for floor in reversed(capacities):
        which, offset, used = best_fit(lengths, capacities, floor)
        final = np.array(capacities, np.int64)[np.searchsorted(capacities, used)]
        if best is None or final.sum() < best[2].sum():
            best = which, offset, final
    return best


def pack(
    items: DataFrame,
    id_col: str = "doc_id",
    length_col: str = "length",
    capacities: tuple[int, ...] = CAPACITIES,
    shard_units: int = SHARD_UNITS,
) -> DataFrame:
    """One row per piece: id, copy (of repeated rows), piece, start, length, bin_id, bin_offset, bin_capacity.

    Lengths are written once and read for the shard count and for the pieces; the small table stays for the result.
    """
    capacities = tuple(sorted({int(c) for c in capacities}))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    top, kind = capacities[-1], items.schema[id_col].dataType.simpleString()
    base = items.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("n")).where("n > 0")
    # Repeated rows are counted first and numbered again, so that they hash apart.
    counted, _ = written(base.groupBy("id", "n").agg(F.count(F.lit(1)).alias("copies")), "lengths")  # texts are read once
    total = counted.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_units))
    pieces = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top)))
    )
    pieces = pieces.select(
        "id", "copy", "piece", (F.col("piece") * top).alias("start"),
        F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length"),
        F.pmod(F.xxhash64("id", "n", "copy", "piece"), F.lit(shards)).alias("shard"),
    )

    def one_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "id", "copy", "piece"]
        pdf = pdf.sort_values(order, ascending=[False, True, True, True], kind="stable", ignore_index=True)
        which, offset, final = pack_lengths(pdf["length"].tolist(), capacities)
        names = np.array([f"{key[0]}-{b}" for b in range(len(final))], object)
        return pdf[["id", "copy", "piece", "start", "length"]].assign(
            bin_id=names[which], bin_offset=offset, bin_capacity=final[which]
        )

    out = pieces.groupBy("shard").applyInPandas(
        one_shard,
        f"id {kind}, copy long, piece long, start long, length long, bin_id string, bin_offset long, bin_capacity long",
    )
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_units: int = SHARD_UNITS) -> DataFrame:
    """Pack documents by their number of words; one row per piece, none for documents without words."""
    sized = docs.select("doc_id", F.regexp_count(whole(F.col("text")), F.lit(WORD)).cast("long").alias("length"))
    return pack(sized, "doc_id", "length", capacities, shard_units)
