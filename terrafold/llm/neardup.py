"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A document's set holds the distinct shingles of its words (A-Z lower-cased; with fewer words than a shingle the whole
sequence is one). Documents with equal sets form a class, and only its smallest id goes on. A signature has ``SLOTS``
values of 16 bits; two of them at most ``most_errors`` apart must, cut into ``CHUNKS`` chunks, agree on some chunk but
for one slot (pigeonhole). So each chunk gives one key for every slot left out, and every pair under the distance
shares a key: none is missed. Sets of the threshold's similarity exceed the distance with a chance of about 1e-4 at
exactly the threshold, falling fast above it.

No bucket is expanded into pairs. Round one pairs each member with its bucket's smallest id and confirms each id's
nearest; what links merges. Round two takes buckets that still hold different components and pairs every member
outside the bucket's first component with its nearest member of another one; round three pairs all that are still
apart and within the distance, so that no link between components is lost. Pairs of small sets are confirmed inside the
bucket, each in the first bucket that it shares.

A bucket of more than ``BLOCK`` members that still differ is mostly a passage or template that many documents share. Its
members are dealt again by the rarest shingles of their full sets: two sets over the threshold share one of the first
``n - ceil(threshold * n) + 1`` in the order of rarity, so no pair is lost, and documents that share only what is common
do not meet. What is still large then is cut into a grid of blocks. Keys that hold more than a ten-thousandth of the
rows (so ten thousand keys at most) are joined by a broadcast of their counts, all others by a shuffle.

Null and blank texts have an empty set and link with nothing; rows without an id link with nothing, have a null
component and stay; repeated rows are one class, and rows that repeat an id with another text belong to the components
of their classes' least ids; ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, whole, written

CHUNKS, PER_CHUNK = 13, 5
SLOTS = CHUNKS * PER_CHUNK
#: Members of a bucket that is compared at once; larger ones are dealt again.
BLOCK = 1500
#: Keys that count as hot at most, and rows that such a key has at least.
HOT_KEYS, HOT_ROWS = 10_000, 1_000
#: Sets up to this size go along into the buckets and are compared there.
SMALL = 256
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS = odd_numbers(SLOTS, 11)
KEY_FACTORS = odd_numbers(PER_CHUNK, 12)


class Hashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, size: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.split cuts at the six blanks and bytes.lower changes A-Z only."""
    words = text.encode().lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = (out ^ x) * STEP
        return out if len(h) else h
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - size + 1 + k]
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least permuted shingle for each slot."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4000):
        least = np.minimum(least, (FACTORS[:, None] * shingles[at : at + 4000]).min(1))
    return ((least * MIX) >> np.uint64(48)).astype(np.uint16)


def most_errors(threshold: float) -> int:
    """Differing slots allowed, four deviations above those expected at the threshold, under two a chunk."""
    expected = SLOTS * (1 - threshold)
    return min(2 * CHUNKS - 1, ceil(expected + 4 * sqrt(expected * threshold)))


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """Keys of each signature: a chunk's slots but one, for every chunk and slot."""
    terms = (sigs.reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64) + np.uint64(1)) * KEY_FACTORS
    terms ^= terms >> np.uint64(31)
    left_out = terms.sum(2, keepdims=True, dtype=np.uint64) - terms
    place = np.arange(1, SLOTS + 1, dtype=np.uint64).reshape(1, CHUNKS, PER_CHUNK) * STEP
    key = (left_out + place) * MIX
    return (key ^ (key >> np.uint64(32))).reshape(len(sigs), SLOTS).astype(np.int64)


def described(docs: DataFrame, size: int) -> DataFrame:
    """id (0 for null), whether there is one, number of shingles, digest of the set, signature and, if small, the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            n, digests, sigs, small = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, size, hashes)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s).tobytes() if len(s) else b"")
                small.append(s.tobytes() if len(s) <= SMALL else None)
            yield pd.DataFrame({"id": pdf["id"], "named": pdf["named"], "n": n, "digest": digests, "sig": sigs, "small": small})

    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("named"), whole(F.col("text")).alias("text")
    )
    return rows.mapInPandas(run, "id long, named boolean, n long, digest binary, sig binary, small binary")


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted`` (a written table: one row a key, with ``members``); hot keys are broadcast.

    Of ``total`` rows, at most ``HOT_KEYS`` keys can have more than their share of that many, so the broadcast is bounded.
    """
    hot = counted.where(F.col("members") > max(HOT_ROWS, total // HOT_KEYS))
    if hot.isEmpty():
        return rows.join(counted, key, how)
    cold = counted.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, id) for each key of each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                sigs = np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part), SLOTS)
                yield pd.DataFrame({"key": keys_of(sigs).ravel(), "id": np.repeat(part["id"].to_numpy(), SLOTS)})

    return nodes.select("id", "sig").mapInPandas(run, "key long, id long")


def within(pairs: DataFrame, nodes: DataFrame, errors: int, threshold: float) -> DataFrame:
    """(a, b, errors) of the pairs whose signatures and sizes allow the threshold."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), SLOTS) for c in ("sig_a", "sig_b"))
            apart = (x != y).sum(1)
            yield pdf[["a", "b"]].assign(errors=apart)[apart <= errors]

    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long, errors int")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, set) of the documents with the given ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "set": [shingle_set(t, size, hashes).tobytes() for t in pdf["text"]]})

    texts = docs.select(F.col("doc_id").alias("id"), whole(F.col("text")).alias("text")).join(ids, "id", "left_semi")
    return texts.mapInPandas(run, "id long, set binary")


def rare_keys(docs: DataFrame, ids: DataFrame, size: int, percent: int, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(key, id): for each of the ids, the shingles of its prefix in the order of rarity that others of the ids have too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, held in zip(pdf["id"], pdf["set"], strict=True):
                s = np.frombuffer(held, np.uint64).astype(np.int64)
                yield pd.DataFrame({"id": i, "row": xxhash.xxh3_64_intdigest(held) >> 1, "n": len(s), "key": s})

    sets = kept(full_sets(docs, ids, size), "hot-sets")
    shingles = kept(sets.mapInPandas(run, "id long, row long, n long, key long"), "hot-shingles")
    seen = kept(shingles.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "hot-seen")
    common = join_counted(shingles, seen, "key", shingles.count())
    each = common.groupBy("id", "row", "n").agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("by_rarity"))
    # What only one document has comes first and meets nothing; the rest of the prefix are the rarest of the others.
    length = F.expr(f"n - ceil(n * {percent} / 100) + 1 - (n - size(by_rarity))").cast("int")
    prefix = each.where(length > 0).select("id", F.explode(F.slice("by_rarity", F.lit(1), length)).alias("x"))
    return kept(prefix.select(F.col("x")["key"].alias("key"), "id").distinct(), "hot-keys")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    one = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, label) of every linked id: the smallest id that it reaches.

    Each round hooks every label on its smallest neighbour, follows the hooks to their ends by doubling, and contracts
    the links to the new labels, until no link joins two labels.
    """
    edges, path = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    files = [path]
    labels, path = written(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("label", F.col("id")), "labels")
    files.append(path)
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        hooks, path = written(hooks, "hooks")
        files.append(path)
        while True:
            onward = hooks.select(F.col("label").alias("to"), F.col("to").alias("further"))
            stepped, path = written(
                hooks.join(onward, "to", "left").select("label", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks"
            )
            files.append(path)
            hooks, moved = stepped.select("label", "to"), not stepped.where("moved").isEmpty()
            if not moved:
                break
        labels, path = written(labels.join(hooks, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        files.append(path)
        to_a, to_b = (hooks.select(F.col("label").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b"))
        moved_edges = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        edges, path = written(moved_edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        files.append(path)
    return labels, files


def mixed(keys: DataFrame, labels: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The keys' members with their labels, and (key, members, home) of the keys with different labels.

    ``home`` is the label of the key's smallest id.
    """
    named = keys.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    stats = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "id").alias("home")
    )
    return named, kept(stats.where("low <> high and members > 1").select("key", "members", "home"), "mixed")


def apart_in_buckets(
    named: DataFrame, stats: DataFrame, total: int, nodes: DataFrame, errors: int, percent: int, nearest_only: bool, dealt_again: bool
) -> DataFrame:
    """(a, b, sure) of members of one bucket with different labels: confirmed links, or pairs within the distance.

    Members outside the label of the bucket's smallest id are compared with all members of other labels: at least one
    of any two labels is outside. Small sets are confirmed here, and of their links only those that join something new
    come out. Of the other pairs, ``nearest_only`` gives each member its nearest partner in a block; without it, small
    sets are left out, as they are done. ``dealt_again`` tells that the keys are shingles of members of large buckets.
    """
    threshold = percent / 100
    all_rows = join_counted(named, stats, "key", total)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = all_rows.where("label <> home").select("key", block.alias("lb"), every.alias("rb"), "id", "label", F.lit(True).alias("outside"))
    right = all_rows.select("key", every.alias("lb"), block.alias("rb"), "id", "label", F.lit(False).alias("outside"))
    rows = left.unionByName(right).join(nodes.select("id", "n", "sig", "small"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf["outside"].to_numpy()
        ids, label, n = (pdf[c].to_numpy() for c in ("id", "label", "n"))
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), SLOTS)
        here, each = pdf["key"].iloc[0], keys_of(sigs)
        sets = [None if x is None else frozenset(np.frombuffer(x, np.uint64).tolist()) for x in pdf["small"]]
        small = np.array([x is not None for x in sets])
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found: list[tuple[int, int, bool]] = []
        inside = np.flatnonzero(~out)
        for i in np.flatnonzero(out):
            other = inside[label[inside] != label[i]]
            if small[i] and not nearest_only:
                other = other[~small[other]]
            other = other[np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i]) - 1e-9]
            distance = (sigs[other] != sigs[i]).sum(1)
            other, distance = other[distance <= errors], distance[distance <= errors]
            if not len(other):
                continue
            shared = each[other] == each[i]
            if dealt_again:  # still only pairs that some chunk's key joins
                first = shared.any(1)
            else:
                first = each[i][shared.argmax(1)] == here  # a pair is looked at in the first bucket that it shares
            both = small[other] & small[i]
            if nearest_only:
                for j in other[both & first].tolist():
                    if find(label[i]) != find(label[j]):
                        common = len(sets[i] & sets[j])
                        if 100 * common >= percent * (n[i] + n[j] - common):
                            root[find(label[i])] = find(label[j])
                            found.append((ids[i], ids[j], True))
                far_apart = ~both & first if dealt_again else ~both
                rest, far = other[far_apart], distance[far_apart]
                if len(rest):
                    found.append((ids[i], ids[rest[np.lexsort((ids[rest], far))[0]]], False))
            else:
                found += [(ids[i], ids[j], False) for j in other[~both & first]]
        a, b, sure = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "sure": np.array(sure, bool)})

    pairs = rows.groupBy("key", "lb", "rb").applyInPandas(run, "a long, b long, sure boolean")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").distinct()


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable) of each row."""
    spark, threshold = docs.sparkSession, percent / 100
    errors, files = most_errors(threshold), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        files.append(path)
        return df

    docs = docs.select("doc_id", "text")
    all_rows = kept(described(docs, size), "signatures")
    classes = all_rows.where("named and n > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("small").alias("small")
    )
    classes = kept(classes, "classes")
    nodes = classes.select("id", "n", "sig", "small")

    all_keys = bucket_keys(nodes)
    live = kept(all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("pivot")).where("members > 1"), "live")
    total = SLOTS * nodes.count()
    keys = kept(join_counted(all_keys, live, "key", total), "keys")
    stars = keys.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = kept(within(stars, nodes, errors, threshold), "stars")
    first = near.groupBy("a").agg(F.min_by("b", F.struct("errors", "b")).alias("b"))
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    sets = kept(full_sets(docs, ids, size), "sets")
    links = kept(confirmed(first, sets, percent), "confirmed")
    labels, more = components(links)
    files += more
    small_keys = keys.where(f"members > 2 and members <= {BLOCK}").select("key", "id")
    large_keys = keys.where(f"members > 2 and members > {BLOCK}").select("key", "id")
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rare: DataFrame | None = None

    def bucket_pairs(nearest_only: bool) -> DataFrame:
        """Pairs of the small buckets, and of the members of large ones dealt again by their rarest shared shingles."""
        nonlocal rare
        out = apart_in_buckets(*mixed(small_keys, labels, kept), total, nodes, errors, percent, nearest_only, False)
        if rare is None:
            named, stats = mixed(large_keys, labels, kept)
            differing = join_counted(named, stats, "key", total).select("id").distinct()
            rare = rare_keys(docs, kept(differing, "hot-ids"), size, percent, kept) if not stats.isEmpty() else large_keys.limit(0)
        if rare.isEmpty():
            return out
        again = apart_in_buckets(*mixed(rare, labels, kept), rare.count(), nodes, errors, percent, nearest_only, True)
        return out.unionByName(again).distinct()

    # The other stars of ids that are still apart, then the buckets.
    rest = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for step in ("stars", "nearest", "all"):
        if step == "stars":
            pairs = rest
        else:
            pairs = kept(bucket_pairs(step == "nearest"), "bucket-pairs")
            sure = pairs.where("sure").select("a", "b")
            if not sure.isEmpty():
                links = links.unionByName(sure)
                labels, more = components(links)
                files += more
            pairs = pairs.where("not sure").select("a", "b")
        la, lb = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}")) for x in ("a", "b"))
        pairs = pairs.join(tested, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left")
        pairs = kept(pairs.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b"), "pairs")
        if pairs.isEmpty():
            continue
        tested = kept(tested.unionByName(pairs), "tested")
        new = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(sets.select("id"), "id", "left_anti")
        if not new.isEmpty():
            sets = kept(sets.unionByName(full_sets(docs, new, size)), "sets")
        found = kept(confirmed(pairs, sets, percent), "confirmed")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels, more = components(links)
            files += more

    # Classes of one row that link with nothing need no join back: they are their own component.
    named = classes.select("digest", "id", "members").join(labels, "id", "left").where("members > 1 or label is not null")
    named = kept(named.select("digest", "members", F.coalesce("label", "id").alias("component")), "components")
    rows = all_rows.select("id", "named", "n", "digest")
    linked = join_counted(rows.where("named and n > 0"), named, "digest", all_rows.count(), "left")
    linked = linked.select("id", "named", "n", F.coalesce("component", "id").alias("component"))
    alone = rows.where("not named or n = 0").select("id", "named", "n", F.col("id").alias("component"))
    result = linked.unionByName(alone).select(
        F.when(F.col("named"), F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("component")).alias("component_id")
    )
    result, _ = written(result, "near-duplicates")
    drop(spark, *files)
    return result


def keep(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id; documents without an id stay."""
    others = link(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Sets of two-word shingles, groups and what stays, for each document; rows without an id stay."""
    return link(docs, 2, 80).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
