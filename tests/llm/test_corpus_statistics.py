"""Sharding, resampling and collocations against brute force, with nulls, repeats, long texts, hot groups and no rows."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import collocations, resample, sharding
from terrafold.llm.common import numbered, temporary, written

DOCS = "doc_id long, text string, lang string, size string, slot string, shard string, law string, score double, rank string, n long"


def docs(spark, rows):
    """(id, text, lang) with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "s", "t", "u", "v", 0.5, "w", 7) for r in rows], DOCS)


# --- sharding


def some_texts(rng, n):
    return [" ".join(rng.choice(("sun", "mœn", "star", "x" * 9)) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("hot", [0, 900])
def test_shards_are_near_equal_ranges_with_groups_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "SMALL_CELL", 50)
    rng = random.Random(5)
    texts = some_texts(rng, 1500) + [None, "", "é" * 9000] + ["one hot text of many rows"] * hot + ["few copies"] * 7
    rng.shuffle(texts)
    rows = [(None if i % 97 == 0 else i % 1000, t, "en") for i, t in enumerate(texts)]
    df = docs(spark, rows).repartition(7)
    got = sharding.assign(df, shards=8, keep=["doc_id", "text", "slot"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    assert all(r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    slots, held, where, weight = defaultdict(list), Counter(), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
        where[r.text or ""].add(r.shard)
        weight[r.text or ""] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    share = sum(held.values()) / 8
    largest = max(r["size"] for r in got)
    assert all(abs(b - share) <= 2 * sharding.TOLERANCE * share + largest for b in held.values())
    # A group is only cut where a boundary misses both its ends by more than the tolerance.
    assert all(len(w) == 1 or weight[t] > 2 * sharding.TOLERANCE * share for t, w in where.items())
    assert all(len(w) <= 2 + weight[t] // share for t, w in where.items())


def test_shards_follow_the_order(spark):
    rows = [(i, f"text {i % 40}", "en") for i in range(400)]
    out = sharding.assign(docs(spark, rows).select("doc_id", "text"), shards=5)
    keyed = out.withColumns({"h": F.shiftrightunsigned(F.xxhash64(F.col("text").cast("binary")), 1), "d": F.shiftrightunsigned(F.xxhash64("doc_id"), 1)})
    found = [(r.shard, r.slot) for r in keyed.orderBy("h", "d").collect()]
    assert found == sorted(found)


def test_shards_of_nothing_and_of_few_rows(spark):
    assert sharding.assign(docs(spark, [])).count() == 0
    few = sharding.assign(docs(spark, [(1, "a", "en"), (1, "a", "en"), (2, None, None)]), shards=16).collect()
    assert len(few) == 3 and all(0 <= r.shard < 16 for r in few) and len({(r.shard, r.slot) for r in few}) == 3
    same = sharding.assign(docs(spark, [(7, "same", "en")] * 3000), shards=4)
    assert {r.shard: r["count"] for r in same.groupBy("shard").count().collect()} == {k: pytest.approx(750, abs=8) for k in range(4)}
    assert "Python" not in same._jdf.queryExecution().executedPlan().toString()


def test_shard_splitters_are_nearest_edges():
    cells = [sharding.Cell(i, 1, b, [(i, i)] * 3) for i, b in enumerate((10, 1, 1, 30, 2, 8, 8))]
    assert sharding.splitters(cells, 2) == [4] and sharding.misplaced(cells, 2, 0.0) == set()
    wide = [sharding.Cell(0, 5, 60, [(0, 9), (1, 1), (0, 4)])]
    assert sharding.misplaced(wide, 3, 0.1) == {0} and wide[0].cut(4) == (0, 0, 3)


# --- resampling

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_features(text, sizes):
    import re

    words = re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in sizes for i in range(len(words) - n + 1)], len(words)


def test_running_sums_equal_sums_of_joined_runs():
    rng = random.Random(2)
    texts = ["", "   ", "One", "ÀB é\x00z 日本 9-8_7", "x" * 70_000 + " y " + "z" * 300] + ["".join(rng.choice("ab Z9é-\n.") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    for t in texts:
        found, n = resample.features(t.encode(), range(1, 5), 1 << 32 - 1)
        want, words = plain_features(t, range(1, 5))
        assert n == words and [int(x) for x in found] == [x % (1 << 32 - 1) for x in want]


def test_shift_is_the_checksum_of_appended_zeros():
    lengths = np.array([0, 1, 2, 3, 255, 256, 70_001])
    sums = np.full(len(lengths), zlib.crc32(b"abc"), np.uint32)
    b = lambda n: bytes([7]) * n
    got = resample.SHIFT(sums, lengths)
    assert [int(g) ^ zlib.crc32(b(n)) for g, n in zip(got, lengths, strict=True)] == [zlib.crc32(b"abc" + b(n)) for n in lengths]


@pytest.mark.parametrize("sizes", [range(1, 2), range(1, 4)])
def test_draw_equals_brute_force(spark, sizes):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(60)] + ["ÉTÉ", "Zwölf"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((0, 5, 19, 20, 40)))), "en") for i in range(300)]
    rows += [(None, "w1 " * 30, None), (300, None, "en"), (301, "w2 " * 25, "en"), (301, "w2 " * 25, "en"), (302, "q" * 50_000, "en")]
    target = [(1, "w1 w2 w3 w1 w2"), (2, None), (3, "ÉTÉ 12")]
    df = docs(spark, rows).repartition(5)
    got = resample.draw(df, spark.createDataFrame(target, "item_id long, text string"), percent=30, sizes=sizes, buckets=97).collect()
    s, t = Counter(), Counter()
    feats = [(i, *plain_features(x, sizes)) for i, x, _ in rows]
    for _, f, _ in feats:
        s.update(x % 97 for x in f)
    for _, x in target:
        t.update(x % 97 for x in plain_features(x, sizes)[0])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 97) / ((s[b] + 1) * (total_t + 97)))) for b in range(97)}
    want = []
    for i, f, n in feats:
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % 97] for x in f)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for k, w in enumerate(able[: len(able) * 30 // 100]):
        w[4] = k + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted([tuple(w[:5]) for w in want], key=key)


def test_draw_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resample.draw(docs(spark, []), empty).count() == 0
    got = resample.draw(docs(spark, [(1, "a b", "en")]), empty).first()
    assert (got.n_features, got["rank"]) == (2, None)


# --- collocations


def plain_phrases(rows, least=30, percent=80, top=2000):
    import re

    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * held[p] >= percent * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_rows(rng, n):
    pool, fixed = [f"w{k}" for k in range(30)], ["new york city hall", "of the", "Été en mer", "one two three four five"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 25)):
            words += [rng.choice(pool)] if rng.random() < 0.8 else rng.choice(fixed).split()
            if rng.random() < 0.1:
                words[-1] += rng.choice(".,;:!?\n\t\x0b")
        rows.append((i, " ".join(words), rng.choice(("en", "fr", None, "und"))))
    return rows


@pytest.mark.parametrize("most_words", [200, 1_000_000])
def test_phrases_equal_brute_force(spark, most_words):
    rows = phrase_rows(random.Random(4), 700)
    rows += [(1, None, "en"), (None, "", "en"), (2, "a b " * 3000, "en"), (3, "x y z.x y z,x y z " * 20, "fr"), (3, "x y z.x y z,x y z " * 20, "fr")]
    got = sorted(tuple(r) for r in collocations.mine(docs(spark, rows).repartition(6), most_words=most_words).collect())
    assert got == plain_phrases(rows) and len({r[0] for r in got}) == 3


def test_phrases_top_limits_and_full_filter(spark, monkeypatch):
    rows = phrase_rows(random.Random(9), 500)
    monkeypatch.setattr(collocations, "FILTER_BITS", 8)  # nearly all pairs pass
    got = sorted(tuple(r) for r in collocations.mine(docs(spark, rows), least=12, percent=60, top=15).collect())
    assert got == plain_phrases(rows, 12, 60, 15)
    assert collocations.mine(docs(spark, [])).count() == collocations.mine(docs(spark, [(1, "a b c", "en")])).count() == 0


def test_index_lists_every_run_with_its_count():
    rng = np.random.default_rng(3)
    for sigma, n in ((2, 50), (5, 400), (40, 3000), (70_000, 500)):
        x = collocations.compact(rng.integers(0, sigma, n))
        for (columns, count), size in zip(collocations.grams(x, sigma, 4), (2, 3, 4), strict=True):
            want = Counter(w for i in range(len(x) - size + 1) if 0 not in (w := tuple(x[i : i + size].tolist())))
            assert dict(zip(zip(*(c.tolist() for c in columns), strict=True), count.tolist(), strict=True)) == want


# --- scratch tables


def test_scratch_blocks_of_threads_do_not_meet(spark):
    from threading import Barrier, Thread

    met, seen = Barrier(2), {}

    def work(name, first):
        with temporary(spark):
            df, _ = written(spark.range(5), name)
            met.wait(60)
            if first:
                met.wait(60)
                seen[name] = df.count()
        if not first:
            met.wait(60)

    threads = [Thread(target=work, args=(n, n == "a")) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == {"a": 5}


def test_numbered_is_gapless_in_order(spark):
    df = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id")
    out, n = numbered(df, "numbers")
    assert n == 1000 and out.where("id <> place").count() == 0
    assert numbered(spark.range(0), "none")[1] == 0
