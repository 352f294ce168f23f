"""Importance resampling towards a target: documents drawn by hashed n-gram weights, with running checksums.

A text is normalised to its words, each with one blank before it, and scanned once: the checksum (CRC-32) of every prefix
that ends with a word is kept. The checksum of any run of words then comes from two prefixes: a prefix's checksum,
moved over as many zero bytes as the run has (a linear map over GF(2), held as byte tables for powers of two), cancels out
of the longer prefix's. So runs of any length cost the same, and no joined text is ever built.

Buckets of the runs are counted over all documents and all target texts. A bucket's gain compares the two; a document's
weight is the sum of its runs' gains, and its score adds noise that depends on its id alone (the draw without
replacement by largest scores). The documents with enough words are ordered by a range exchange, and each partition's
count gives the ranks, so no task sorts them all.

Null and blank texts have no words, no features and the weight 0; texts of any length are scanned whole; a null id draws
its noise as an empty one and comes last among equal scores; repeated rows are scored alike and ranked one after the other;
an empty table or an empty target gives counts of nothing and no error; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, numbered, temporary, whole, written

#: Words are runs of digits, lower-cased letters and whatever lies beyond ASCII; all other bytes part them.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BUCKETS = 10_000
#: Partitions of the order: one for so many documents.
ORDERED_ROWS = 200_000
ALL = np.uint32(0xFFFFFFFF)


def byte_table() -> np.ndarray:
    """The state after one byte, for each low byte of the state (the reflected polynomial 0xEDB88320 is a fixed value)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


STEP = byte_table()


class Shift:
    """Checksums moved over zero bytes: linear over GF(2), so four byte tables for each power of two of the length."""

    def __init__(self) -> None:
        state = np.array([[b << 8 * k for b in range(256)] for k in range(4)], np.uint32)
        self.powers = [STEP[state & 0xFF] ^ (state >> np.uint32(8))]

    def _table(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            last = self.powers[-1]
            self.powers.append(self._through(last, last))
        return self.powers[k]

    @staticmethod
    def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]

    def __call__(self, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = sums.copy()
        for k in range(int(lengths.max(initial=0)).bit_length()):
            on = (lengths >> k) & 1 == 1
            out[on] = self._through(self._table(k), out[on])
        return out


SHIFT = Shift()


def prefixes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of the normalised text (a blank before each word): the checksum of each prefix that ends with a word, from the empty one on, and its length."""
    words = text.translate(NORMAL).split()
    sums = list(accumulate(words, lambda state, w: zlib.crc32(w, zlib.crc32(b" ", state)), initial=0))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.array(sums, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def run_sums(sums: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Checksums of all runs of ``size`` words, joined by one blank, from the prefixes' checksums."""
    if len(sums) <= size:
        return np.empty(0, np.uint32)
    before = sums[: len(sums) - size]
    with_blank = STEP[(before ^ ALL ^ np.uint32(32)) & 0xFF] ^ ((before ^ ALL) >> np.uint32(8)) ^ ALL
    return sums[size:] ^ SHIFT(with_blank, ends[size:] - ends[: len(ends) - size] - 1)


def features(text: bytes | None, sizes: range, buckets: int) -> tuple[np.ndarray, int]:
    """Buckets of all runs of a text, and its number of words."""
    sums, ends = prefixes(text or b"")
    return np.concatenate([run_sums(sums, ends, n) for n in sizes]) % np.uint32(buckets), len(sums) - 1


def bucket_counts(texts: DataFrame, sizes: range, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n): occurrences over all texts, counted in each task first; ``buckets`` rows at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                held += np.bincount(features(text, sizes, buckets)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": some, "n": held[some]})

    raw = texts.select(whole(F.col(f"`{text_col}`")).cast("binary").alias("text"))
    return raw.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, sizes: range, buckets: int) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down; the driver holds one number a bucket."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for into, texts in ((s, docs), (t, target)):
        for r in bucket_counts(texts, sizes, buckets).collect():
            into[r.bucket] = r.n
    ratio = (t + 1.0) * (s.sum() + float(buckets)) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, sizes: range = range(1, 2), seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found, n = features(text, sizes, len(gain))
                rows.append((n, len(found), int(gain[found].sum())))
            yield pd.concat([pdf[["doc_id", "noise"]], pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], index=pdf.index)], axis=1)

    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    # ids as text: a nullable long would pass pandas as a double
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), noise.alias("noise"), whole(F.col("text")).cast("binary").alias("text"))
    out = rows.mapInPandas(score, "doc_id string, noise long, n_words long, n_features long, weight long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def draw(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, sizes: range = range(1, 2), buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: from 1 for the drawn, null for the others.

    ``percent`` of the documents of at least ``least_words`` words are drawn, the highest scores first, ties to the
    smaller id.
    """
    with temporary(docs.sparkSession):
        rows, _ = written(scored(docs, gains(docs, target, sizes, buckets), sizes, seed), "scores")
        able = rows.where(F.col("n_words") >= least_words)
        n = able.count()
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        ranged = able.repartitionByRange(max(1, min(-(-n // ORDERED_ROWS) * 4, 20_000)), *order).sortWithinPartitions(*order)
        placed, _ = numbered(ranged, "ranks")
        rank = F.when(F.col("place") < n * percent // 100, F.col("place") + 1).alias("rank")
        columns = ["doc_id", "n_features", "weight", "score"]
        rest = rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
        return lasting(placed.select(*columns, rank).unionByName(rest), "drawn")[0]
