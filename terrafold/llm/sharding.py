"""Shards of near-equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a hash of their text, then by a hash of their id, then by their line in the written keys, so equal
texts lie side by side. A shard is a range of that order. Its ends are found by counting, never by sorting: the bytes of
equal-width cells of the order give a histogram, and the cells in which a boundary must fall are cut again, round by
round, until an edge of a cell lies within ``tolerance`` of where the boundary should be (a share of a shard's bytes) or
the cell is a single row. Cells with many rows are cut as well. A group of equal texts is an edge's neighbour before it
is cut into, so it stays in one shard unless both its ends miss the boundary by more than the tolerance. After the last
round the rows are exchanged once, by cell, and numbered in each cell; the histogram gives the first slot of each.

The driver holds the histogram: at most 2^16 cells, and a bounded number of finer ones for each round. Every count is
exact and over all rows.

A null text has no bytes and counts as the empty one; every row has a size of at least one byte; a null id is an id;
repeated rows keep a slot each; an empty table gives an empty result; with fewer rows than shards some shards stay
empty; of extra columns those named like a result column are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lasting, temporary, whole, written

#: Rows that a first cell should have, and powers of two of the first cells at least and at most.
CELL_ROWS, LEAST_BITS, MOST_BITS = 20_000, 10, 16
#: Cells into which one that holds a boundary is cut, and rows above which a cell is cut in any case.
PROBES, SMALL_CELL = 256, 1000
#: How far a boundary may lie from its place, as a share of a shard's bytes.
TOLERANCE = 0.01
#: The order: hash of the text, hash of the id, line among the written keys; all are under 2^63 and not negative.
ORDER = ("_text_hash", "_id_hash", "_line")
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass
class Cell:
    """A range of the order: its rows, bytes and the extent of each key column in it."""

    id: int
    rows: int
    bytes: int
    spans: list[tuple[int, int]]

    def cut(self, into: int) -> tuple[int, int, int]:
        """Key column, start and width of the ranges that cut this cell into at most so many; two at least hold rows."""
        k, (low, high) = next((k, s) for k, s in enumerate(self.spans) if s[0] < s[1])
        return k, low, -(-(high - low + 1) // into)


def keys(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept columns with size, checksum and the key columns of each row."""
    raw = whole(F.col(f"`{text_col}`")).cast("binary")
    positive = lambda h: F.shiftrightunsigned(h, 1)
    return docs.select(
        *[F.col(f"`{c}`") for c in keep], (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
        positive(F.xxhash64(raw)).alias("_text_hash"), positive(F.xxhash64(F.col(f"`{id_col}`"))).alias("_id_hash"),
        F.monotonically_increasing_id().alias("_line"),
    )


def histogram(rows: DataFrame) -> list[Cell]:
    """The cells that hold rows, by number."""
    ends = [f(k) for k in ORDER for f in (F.min, F.max)]
    found = rows.groupBy("_cell").agg(F.count(F.lit(1)), F.sum("size"), *ends).collect()
    return sorted((Cell(r[0], r[1], r[2], [(r[3], r[4]), (r[5], r[6]), (r[7], r[8])]) for r in found), key=lambda c: c.id)


def misplaced(cells: list[Cell], shards: int, tolerance: float) -> set[int]:
    """Places of the cells in which a boundary must fall and whose edges are too far from it."""
    ends = list(accumulate((c.bytes for c in cells), initial=0))
    share, out = ends[-1] / shards, set()
    for k in range(1, shards):
        at = min(bisect_right(ends, k * share), len(cells)) - 1
        off = min(k * share - ends[at], ends[at + 1] - k * share)
        if off > tolerance * share and cells[at].rows > 1:
            out.add(at)
    return out


def splitters(cells: list[Cell], shards: int) -> list[int]:
    """For each boundary the number of cells before it: the edge nearest to its place, the earlier one on ties."""
    ends = list(accumulate((c.bytes for c in cells), initial=0))
    out = []
    for k in range(1, shards):
        place = k * ends[-1] / shards
        at = min(bisect_right(ends, place), len(cells)) - 1
        out.append(at if place - ends[at] <= ends[at + 1] - place else at + 1)
    return out


def cut(rows: DataFrame, cuts: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Rows with the finer cell of those that lie in (cell, key column, start, width, first new number)."""
    table = rows.sparkSession.createDataFrame(cuts, "_cell long, _k int, _low long, _width long, _new long")
    value = F.when(F.col("_k") == 0, F.col(ORDER[0])).when(F.col("_k") == 1, F.col(ORDER[1])).otherwise(F.col(ORDER[2]))
    finer: Column = F.expr("_new + (_value - _low) div _width")
    joined = rows.join(F.broadcast(table), "_cell", "left").withColumn("_value", value)
    return joined.withColumn("_cell", F.coalesce(finer, "_cell")).drop("_k", "_low", "_width", "_new", "_value")


def cells_of(rows: DataFrame, shards: int, tolerance: float) -> tuple[DataFrame, list[Cell]]:
    """Rows with their cell, and all cells in order, cut until every boundary has an edge near it and no cell is large."""
    n = rows.count()
    bits = min(max((max(n // CELL_ROWS, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    per_cell = n / (1 << bits)
    rows = rows.withColumn("_cell", F.shiftrightunsigned(ORDER[0], 63 - bits))
    cells, free = histogram(rows), 1 << bits
    while True:
        probed = misplaced(cells, shards, tolerance) if cells else set()
        cuts, places = [], {}
        for at, c in enumerate(cells):
            if at in probed or c.rows > max(SMALL_CELL, 4 * per_cell):
                into = PROBES if at in probed else max(2, min(PROBES, round(2 * c.rows / max(per_cell, SMALL_CELL / 4))))
                cuts.append((c.id, *c.cut(into), free))
                places[at] = (free, free + into)
                free += into
        if not cuts:
            return rows, cells
        rows = cut(rows, cuts)
        finer = histogram(rows.where(F.col("_cell") >= cuts[0][-1]))
        first = [c.id for c in finer]
        cells = [
            x for at, c in enumerate(cells)
            for x in (finer[bisect_right(first, places[at][0] - 1) : bisect_right(first, places[at][1] - 1)] if at in places else [c])
        ]


def assign(
    docs: DataFrame, shards: int = 16, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """The kept columns (all by default) with size, text_crc32, law, shard, slot and grown_shard (null: no law of keys)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    with temporary(docs.sparkSession):
        rows, _ = written(keys(docs, keep, id_col, text_col), "shard-keys")
        placed, cells = cells_of(rows, shards, tolerance)
        ends, table, shard, slot = splitters(cells, shards) if cells else [], [], 0, 0
        for at, c in enumerate(cells):
            here = bisect_right(ends, at)
            shard, slot = (here, 0) if here != shard else (shard, slot)
            table.append((c.id, shard, slot))
            slot += c.rows
        starts = docs.sparkSession.createDataFrame(table, "_cell long, shard int, _first long")
        own = Window.partitionBy("_cell").orderBy(*ORDER)
        slots = placed.join(F.broadcast(starts), "_cell").withColumn("slot", F.col("_first") + F.row_number().over(own) - 1)
        out = slots.select(
            *[F.col(f"`{c}`") for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
        )
        return lasting(out, "shards")[0]
