"""Collocations: phrases whose words come together far more often than their parts do apart.

Texts become sequences of word numbers, parted at marks and line ends, and are held in shards of bounded size and one
language each. Every shard is indexed for search in both directions: the Burrows-Wheeler transform of its sequence and of
the reversed one, each in the order of contexts as deep as the longest phrase. Starting from single words, the intervals of
all phrases of a depth are extended by every word that follows (in the index of the reversed sequence) and, at the next
depth, by every word that precedes (in the other), both intervals kept in step, which lists each phrase of the shard
with its count. The counts are summed across shards.

What can't be frequent is not listed: first the words themselves are counted, and rarer ones part the sequences; then the
pairs, and longer phrases are listed only where all their pairs pass a filter of fixed size made from the frequent pairs.
Frequent pairs always pass; what passes without need is dropped by its exact count, so the filter saves work and changes
no result, however full it is.

All counts after the first are of frequent phrases only, far fewer than the words. A longer phrase that nearly always
holds a shorter one removes it; one more word to the left or right is enough to look for, as counts never rise with
length. Scores are whole numbers in decimal arithmetic of 38 digits.

Null and blank texts have no words; a null language is ``und``; texts of any length are counted whole (one text is never
split between shards); repeated rows count each time; equal scores are ordered by count and then by the phrase's bytes;
an empty table gives an empty result; ids and extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, numbered, temporary, whole, written

#: A-Z lower-cased, marks and line ends as one part sign, tabs as blanks.
PARTED = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n")
#: Words of a shard, about; bits of the filter of frequent pairs; words of a phrase at most.
SHARD_WORDS, FILTER_BITS, LONGEST = 1_000_000, 26, 4
SHARD = "lang string, words array<string>, counts array<long>, seq binary"
LOW = 0xFFFFFFFF


class Numbers(dict):
    """Numbers of words in the order of their first meeting; 0 is the part sign."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def shards(texts: DataFrame, most_words: int = SHARD_WORDS) -> DataFrame:
    """Texts (lang, text) of each task as shards: words in order of their numbers, their counts and the sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def shard(lang: str) -> pd.DataFrame:
            numbers, parts = held.pop(lang)
            del sizes[lang]
            seq = np.concatenate(parts)
            words = [w.decode() for w in numbers][1:]
            return pd.DataFrame([(lang, words, np.bincount(seq, minlength=len(numbers))[1:], seq.tobytes())], columns=["lang", "words", "counts", "seq"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                tokens = TOKEN.findall(text.translate(PARTED))
                if not tokens:
                    continue
                numbers, parts = held.setdefault(lang, (Numbers({b"\n": 0}), []))
                parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                parts.append(np.zeros(1, np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(tokens) + 1
                if sizes[lang] >= most_words:
                    yield shard(lang)
                elif sum(sizes.values()) >= 2 * most_words:
                    yield shard(max(sizes, key=sizes.get))
        for lang in list(held):
            yield shard(lang)

    return texts.mapInPandas(run, SHARD)


class Index:
    """Burrows-Wheeler transform of a sequence of symbols (0 parts), in the order of contexts of ``depth`` symbols."""

    def __init__(self, x: np.ndarray, sigma: int, depth: int) -> None:
        n, bits = len(x), max(1, (sigma - 1).bit_length())
        padded, together = np.concatenate([x, np.zeros(depth, x.dtype)]), max(1, 62 // bits)
        order = None
        for at in reversed(range(0, depth, together)):  # the last symbols first; a key holds as many as fit
            key = np.zeros(n, np.int64)
            for k in range(at, min(at + together, depth)):
                key = key << bits | padded[k : k + n]
            order = np.argsort(key, kind="stable" if depth > together else None) if order is None else order[np.argsort(key[order], kind="stable")]
        self.size, self.sigma, self.bwt = n, sigma, x[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=sigma))])
        self.ranks = np.sort(self.bwt * n + np.arange(n))  # (symbol, place) in order: a place's rank among its symbol by search

    def extend(self, low: np.ndarray, count: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of the intervals: (parent, symbol, interval's start here, its size, its start in the other index)."""
        parent = np.repeat(np.arange(len(low)), count)
        first = np.cumsum(count) - count
        place = np.arange(len(parent)) - first[parent] + low[parent]
        pair = np.sort(parent * self.sigma + self.bwt[place])  # intervals are apart, so these are the size of the sequence at most
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        size = np.diff(np.append(at, len(pair)))
        parent, symbol = np.divmod(pair[at], self.sigma)
        before = at - first[parent]  # smaller symbols in the interval: so much further on in the other index
        kept = symbol > 0
        parent, symbol, size, before = parent[kept], symbol[kept], size[kept], before[kept]
        start = np.searchsorted(self.ranks, symbol * self.size + low[parent])
        return parent, symbol, start, size, other[parent] + before


def grams(x: np.ndarray, sigma: int, depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each length from 2 on: the symbols of every run that no 0 parts, column by column, and its count."""
    before, after = Index(x, sigma, depth), Index(x[::-1], sigma, depth)
    columns = [np.arange(1, sigma)]
    count = np.diff(before.starts)[1:]
    low, low_reversed = before.starts[1:sigma], after.starts[1:sigma]
    for size in range(2, depth + 1):
        if size % 2 == 0:
            parent, symbol, low_reversed, count, low = after.extend(low_reversed, count, low)
            columns = [c[parent] for c in columns] + [symbol]
        else:
            parent, symbol, low, count, low_reversed = before.extend(low, count, low_reversed)
            columns = [symbol] + [c[parent] for c in columns]
        yield columns, count


def compact(x: np.ndarray) -> np.ndarray:
    """The sequence with one 0 before, after and between its runs."""
    x = np.concatenate([[0], x, [0]])
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]


def bucket(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def listed(sequences: DataFrame, sizes: range, passes: np.ndarray | None = None) -> DataFrame:
    """(a, b, n) of each shard's phrases of the given sizes: up to four word numbers of 32 bits in two longs.

    ``passes`` is the filter, as bytes of bits: words whose pair does not pass are parted.
    """
    depth, held = sizes[-1], sequences.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for pdf in batches:
            for raw in pdf["seq"]:
                x = np.frombuffer(raw, np.int32).astype(np.int64)
                if bits is not None:
                    at = bucket(x[:-1] << 32 | x[1:])
                    ok = (bits[at >> 3] >> (at & 7) & 1 == 1) & (x[:-1] > 0) & (x[1:] > 0)
                    wide = np.zeros(2 * len(x), np.int64)
                    wide[::2] = np.where(np.append(ok, False) | np.append(False, ok), x, 0)
                    x = compact(wide[np.append(np.stack([np.ones(len(ok), bool), ~ok], 1).ravel(), [True, True])])
                names, x = np.unique(x, return_inverse=True)
                if len(names) < 2:
                    continue
                for columns, n in grams(x, len(names), depth):
                    if len(columns) in sizes and len(n):
                        w = [names[c] for c in columns] + [np.int64(0)] * (4 - len(columns))
                        yield pd.DataFrame({"a": w[0] << 32 | w[1], "b": np.broadcast_to(w[2] << 32 | w[3], len(n)), "n": n})

    return sequences.select("seq").mapInPandas(run, "a long, b long, n long")


def frequent(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """Bytes of bits, one for each bucket of the pairs; the driver gets 2^20 numbers at most, whatever their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = bucket(pdf["a"].to_numpy())
            yield pd.DataFrame({"at": at >> 5, "bits": np.int64(1) << (at & 31)})

    held = np.zeros(1 << (FILTER_BITS - 5), "<u4")
    for r in pairs.mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        held[r["at"]] = r.bits
    return held.view(np.uint8)


def renumbered(held: DataFrame, known: DataFrame) -> DataFrame:
    """(seq) of each shard in the numbers of the frequent words, rare ones parting it; ``known`` has of (the shard), place and number."""

    def run(rows: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw, size in zip(rows["seq"], rows["size"], strict=True):
            table = np.zeros(size + 1, np.int64)
            table[numbers["place"].to_numpy() + 1] = numbers["number"].to_numpy()
            out.append(compact(table[np.frombuffer(raw, np.int32)]).astype(np.int32).tobytes())
        return pd.DataFrame({"seq": out})

    sized = held.select("shard", "seq", F.size("words").alias("size"))
    return sized.groupBy("shard").cogroup(known.groupBy("of")).applyInPandas(run, "seq binary")


def word(i: int) -> Column:
    """The i-th word number of a phrase, from 0."""
    long = F.col("ab"[i // 2])
    return F.shiftright(long, 32) if i % 2 == 0 else long.bitwiseAND(LOW)


def packed(numbers: list[Column], a: str, b: str) -> list[Column]:
    """The two longs of a phrase of these word numbers, under two names."""
    w = [*numbers, *[F.lit(0).cast("long")] * (4 - len(numbers))]
    return [F.shiftleft(w[i], 32).bitwiseOR(w[i + 1]).alias(n) for i, n in ((0, a), (2, b))]


def best_cuts(counts: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, a, b, size, f, l, r, score) of each phrase by its lowest-scoring cut, ties to the earliest.

    ``counts`` has a, b, size, f of all frequent phrases and single words, and lang for the words.
    """
    cut = lambda size, k: F.struct(F.lit(k).alias("k"), *packed([word(i) for i in range(k)], "la", "lb"), *packed([word(i) for i in range(k, size)], "ra", "rb"))
    cuts = F.lit(None)
    for size in range(2, LONGEST + 1):
        cuts = F.when(F.col("size") == size, F.array(*[cut(size, k) for k in range(1, size)])).otherwise(cuts)
    rows = counts.where("size > 1").select("a", "b", "size", "f", F.explode(cuts).alias("cut")).select("a", "b", "size", "f", "cut.*")
    left = counts.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("f").alias("l"), "lang")
    right = counts.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("f").alias("r"))
    rows = rows.join(left, ["la", "lb"]).join(right, ["ra", "rb"])
    score = F.expr(f"(cast({scale} as decimal(18,0)) * cast(f as decimal(19,0))) div cast(l + r as decimal(38,0))").alias("score")
    least = F.min(F.struct(score, "k", "l", "r")).alias("cut")
    return rows.groupBy("a", "b", "size", "f").agg(F.max("lang").alias("lang"), least).select("lang", "a", "b", "size", "f", "cut.l", "cut.r", "cut.score")


def longest_kept(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that no phrase of one more word holds with ``percent`` of their count."""
    parts = F.lit(None)
    for size in range(3, LONGEST + 1):
        halves = [F.struct(*packed([word(i) for i in range(k, k + size - 1)], "a", "b")) for k in (0, 1)]
        parts = F.when(F.col("size") == size, F.array(*halves)).otherwise(parts)
    above = phrases.where("size > 2").select(F.explode(parts).alias("p"), F.col("f").alias("above")).groupBy("p.a", "p.b").agg(F.max("above").alias("above"))
    inside = F.expr(f"cast(100 as decimal(3,0)) * cast(above as decimal(19,0)) >= cast({percent} as decimal(3,0)) * cast(f as decimal(19,0))")
    return phrases.join(above, ["a", "b"], "left").where(~F.coalesce(inside, F.lit(False))).drop("above")


def mine(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, most_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    with temporary(docs.sparkSession):
        texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole(F.col("text")).cast("binary").alias("text"))
        held, _ = written(shards(texts, most_words).withColumn("shard", F.monotonically_increasing_id()), "phrase-shards")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        totals = held.groupBy("lang").agg(F.sum(total).alias("n"))
        met = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("shard", "lang", "place", "x.words", "x.counts")
        met = met.withColumnsRenamed({"words": "word", "counts": "n"})
        words = met.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        words, n_words = numbered(words, "phrase-words")
        if n_words >= 1 << 31:
            raise ValueError("word numbers beyond 31 bits")
        words = words.withColumn("number", F.col("place") + 1).drop("place")
        known = met.join(words, ["lang", "word"]).select(F.col("shard").alias("of"), "place", "number")
        sequences, _ = written(renumbered(held, known), "phrase-sequences")

        pairs, _ = written(frequent(listed(sequences, range(2, 3)), least), "phrase-pairs")
        longer = frequent(listed(sequences, range(3, LONGEST + 1), pair_filter(pairs)), least)
        singles = words.select(*packed([F.col("number")], "a", "b"), F.lit(1).alias("size"), "f", "lang")
        size = F.when(word(3) > 0, 4).when(word(2) > 0, 3).otherwise(2)
        counts = pairs.unionByName(longer).withColumn("size", size).withColumn("lang", F.lit(None).cast("string")).unionByName(singles)
        counts, _ = written(counts, "phrase-counts")

        kept = longest_kept(best_cuts(counts), percent)
        # All that may be among the first: ties stay until the phrases themselves can order them.
        by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
        kept = kept.withColumn("at", F.rank().over(by)).where(F.col("at") <= top).drop("at")
        kept, _ = written(kept, "phrase-kept")
        each = F.posexplode(F.slice(F.array(*[word(i) for i in range(4)]), F.lit(1), F.col("size"))).alias("i", "number")
        spelt = kept.select("a", "b", each).join(words.select("number", "word"), "number").groupBy("a", "b")
        phrases = spelt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
        last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
        out = kept.join(phrases, ["a", "b"]).join(totals, "lang").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
        return lasting(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score"), "phrases")[0]
