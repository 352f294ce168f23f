"""Each operator against brute force on small tables with nulls, blanks, ties, repeats, clashing columns and no rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import ann, chat, neardup, packing, pieces, pii, quality, queries, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, spans string, kept boolean, id string, n long, v double, label string"


def docs(spark, texts, start=0):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i + start, t, "en", "x", True, "y", 7, 0.5, "z") for i, t in enumerate(texts)], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- personal data


def base_spans(t):
    def luhn(d):
        twice = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m.group())]


def test_pii_base_and_added_spans(spark):
    rng = random.Random(3)
    texts = [None, "", " " * 9, "a@b.com_x@y.org", "é4111 1111 1111 1111 a.b@c-d.ef +1 (456) 555-2186", "9" * 50_000, "a" * 50_000, "x@" + "a.b" * 9000]
    for letters in ("ab@.+_-1", "12 -3456789+().", "0123456789. ", "a@b.c +1-2 (34)5 6.7@"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == sha(",".join(base_spans(t))), t[:80]
    more = pii.digest(docs(spark, ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00", "social security 123-45-6789", "part 123-45-6789", "call 415 555 2671"]))
    assert [r.spans for r in more.orderBy("doc_id").collect()] == ["iban:5:32", "", "ssn:16:27", "", "local_phone:5:17"]
    red = pii.redact(docs(spark, ["to a@b.com or +1 (456) 555-2186.", None]))
    assert [r.text for r in red.orderBy("doc_id").collect()] == ["to [EMAIL] or [PHONE].", None] and red.columns == docs(spark, []).columns
    assert pii.digest(docs(spark, [])).count() == 0


def test_pii_many_matches_in_one_text_take_linear_time(spark):
    import time

    texts = [" ".join(f"write to u{i}@m.org, call +1 555 {i:07d}" for i in range(n)) for n in (10, 8000)]
    df = docs(spark, texts)
    pii.digest(docs(spark, texts[:1])).collect()
    began = time.perf_counter()
    got = pii.digest(df).orderBy("doc_id").collect()
    assert time.perf_counter() - began < 10
    assert [r.base_sha256 for r in got] == [sha(",".join(base_spans(t))) for t in texts]
    red = [r.text for r in pii.redact(df.select("doc_id", "text", F.lit(1).alias("pii"))).orderBy("doc_id").collect()]
    assert red == [re.sub(r"\+1 555 [0-9]{7}", "[PHONE]", re.sub(r"u[0-9]+@m.org", "[EMAIL]", t)) for t in texts]


def test_iban_ends_where_its_country_says(spark):
    de, gb, grouped = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    texts = [f"{de} BIC: X", f"{grouped} BIC COBADEFF", f"pay {de} 12 May", f"{grouped} {gb}", f"é AB12 {grouped} CODE", f"no {de}7 A", f"{de} {de}", f"QQ12 {gb} Pay"]
    got = [r.spans for r in pii.digest(docs(spark, texts)).orderBy("doc_id").collect()]
    spans = [",".join(x for x in s.split(",") if x.startswith("iban")) for s in got]
    assert spans == ["iban:0:22", "iban:0:27", "iban:4:26", "iban:0:27,iban:28:55", "iban:7:34", "", "iban:0:22,iban:23:45", "iban:5:32"]
    assert pii.redact(docs(spark, texts[1:2])).first().text == "[IBAN] BIC COBADEFF"


# --- URL filters


def test_urls(spark):
    pages = [
        (1, "https://a.com/x", "com/", "allow"), (2, "http://Sub.Example.com/en/1", "example.com/en/", "block"), (3, "http://www.example.com/en/1?q#f", "www.example.com/en/", "allow"),
        (4, "http://x.net/es/", "net/es/", "block"), (5, "http://net/fr/?a", "net/fr/", "block"), (6, "http://xcom/", None, None), (7, None, None, None), (8, "no scheme", None, None),
        (9, "http://a.com", None, None), (9, "http://a.com", None, None), (10, "a://b.org/x://c?d://e", None, None), (11, "", None, None),
    ]
    df = spark.createDataFrame([(i, u, "h", "x", 1.0) for i, u, _, _ in pages], "page_id long, url string, html string, rule string, f_length double")
    got = urls.judge(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    for i, u, rule, verdict in pages:
        assert by[i].rule == rule and by[i].verdict in ("allow", "block") and (verdict is None or by[i].verdict == verdict)
    assert (by[2].host, by[2].path) == ("sub.example.com", "/en/1") and (by[7].host, by[7].path) == ("", "") == (by[8].host, by[8].path)
    assert (by[10].host, by[10].path) == ("b.org", "/x://c") and by[9].path == ""
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df.where("page_id = 1")).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://www.example.com/en/" + "a/" * 50_000), (2, "http://x.org/?" + "k=v&" * 50_000)], "page_id long, url string")
    assert [r.rule for r in urls.judge(df.select("page_id", "url").unionByName(long)).where("length(path) > 9999 or host = 'x.org'").orderBy("page_id").collect()] == ["www.example.com/en/", None]


def fitting_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = [(len(r), r, v) for v, r in urls.RULES if (host + ".").endswith("." + r.split("/")[0] + ".") or host == r.split("/")[0] if path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(hits)[1:] if hits else (None, None))


def test_urls_rules_on_all_pages_and_trees_on_unseen_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for r in pages.collect():
        host, path, rule, verdict = fitting_rule(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule) and (verdict is None or g.verdict == verdict)
    # labelled URLs of hosts that the trees never saw, against always guessing the commoner class
    host, path = urls.host_and_path(F.col("url"))
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", host.alias("host"), path.alias("path"))
    ruled = df.withColumn("label", (urls.rule_fit(F.col("host"), F.col("path"), urls.RULES)[1] == "block").cast("double")).where("label is not null")
    unseen = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    model, rates = urls.fit(ruled.where(~unseen))
    right, share = urls.score(ruled.where(unseen), model, rates).agg(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")), F.avg("label")).first()
    assert right >= 0.8 and right > max(share, 1 - share)

# --- chat


def test_chat_round_trip(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", None), (None, 2, "assistant", "r"), (1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 5, "a: b#<\\", "x\ny"), (4, 0, "assistant", "<" * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rank string")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "user", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        told = "".join(t for role, t in turns if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(told), sha(told))
    assert chat.digest(df.limit(0)).count() == 0


def test_reply_trees_rank_paths(spark):
    m = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", "c", 0.0), (1, 5, 2, "user", "d", 9.0),
         (2, 1, 9, "user", "root without parent", None), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "user", "z", 0.0)]
    messages = spark.createDataFrame(m, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    turns = chat.unroll(messages, best=None).orderBy("tree_id", "rank", "at").collect()
    paths = {}
    for t in turns:
        paths.setdefault((t.tree_id, t["rank"]), []).append(t.text)
    assert paths == {(1, 1): ["q", "a", "d"], (1, 2): ["q", "b", "c"], (2, 1): ["root without parent"]}
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)], messages.schema)
    assert [r.text for r in chat.unroll(deep).orderBy("at").collect()] == [str(i) for i in range(70)]


# --- quality


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a b", "a a a a", "x y z x y z", "l1\nl1\n\n \nl2", "\x0bw\x0c#*$%&|<>", "word " * 3000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (failed and r.kept)
    prose = " ".join(f"word{i} and then{i % 7}" for i in range(60))
    junk = [prose, prose.replace(" ", "*** "), prose.upper(), "short"]
    assert [r.doc_id for r in quality.keep(docs(spark, junk)).collect()] == [0]
    order = quality.order_rules(docs(spark, junk), quality.BASE + quality.RULES)
    assert {r.name for r, _, _ in order} == {r.name for r in quality.BASE + quality.RULES}
    assert quality.digest(docs(spark, [])).count() == 0 and quality.keep(docs(spark, [])).count() == 0
    short = spark.createDataFrame([(1, "a clean short text", "r"), (1, "!!! !!!", "r"), (None, "one more", None), (2, None, "r"), (3, " ", None)], "doc_id long, text string, reason string")
    assert sorted(map(tuple, quality.keep(short, quality.CLEANING).collect()), key=str) == [(1, "a clean short text", "r"), (None, "one more", None)]


def test_quality_orders_rules_by_rejection_per_cost(spark):
    df = docs(spark, [f"{'x' * 40} {i} " * 40 for i in range(300)])
    weak = quality.Rule("weak", "regexp_count({text}, '(x+x+)+9 3 ') > 30 and {n_repeat_words} < 0")
    strong = quality.Rule("strong", "length({text}) % 2 = 0 or length({text}) > 10")
    for rules in ((weak, strong), (strong, weak)):
        for _ in range(3):
            assert [r.name for r, _, _ in quality.order_rules(df, rules)] == ["strong", "weak"]


def test_quality_sample_is_small_on_many_partitions(spark):
    df = docs(spark, [f"text {i}" for i in range(4000)]).repartition(40)
    assert 300 < quality.sampled(df, 500).count() < 800


# --- toxicity


def test_toxicity_learns_and_tolerates_insertions(spark):
    rng = random.Random(2)
    syllables = "th er on an re he in ed nd ha".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["fuzzwit", "gloopbag", "mudskull"]
    texts, labels = [], []
    for i in range(300):
        w = [word() for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(insults)
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    df = docs(spark, texts)
    machine = toxicity.train(df, spark.createDataFrame([*labels, (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int"))
    plain = " ".join(word() for _ in range(40))
    new = [f"{plain} {x} {plain}" for x in ("Fuzzwit!", "fuzz-wit", "g.l.o.o.p.b.a.g", "mudskkull", "f u z z w i t", "there")] + [None, "", "\n"]
    got = [r.score for r in toxicity.score(docs(spark, new), machine).orderBy("doc_id").collect()]
    assert all(s >= 0.5 for s in got[:5]) and all(0 <= s < 0.5 for s in got[5:])
    assert toxicity.keep(docs(spark, new), machine).count() == 4
    for known, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        machine = toxicity.train(df, spark.createDataFrame(known, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(df, machine).collect()} == {want}


def subsequences(word):
    """Weight of each gapped triple of codes within a span of five, by direct enumeration."""
    c = [toxicity.EDGE, *(int(toxicity.CODES[min(ord(x), 0xFFFF)]) for x in word), toxicity.EDGE]
    out = Counter()
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            for k in range(j + 1, min(i + 5, len(c))):
                out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i - 2)
    return out


def test_toxicity_features_and_landmarks_equal_the_full_kernel():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcé-1日x") for _ in range(rng.randint(1, 14))) for _ in range(60)})
    direct = [subsequences(w) for w in words]
    norm = [sum(v * v for v in d.values()) ** 0.5 for d in direct]
    full = np.array([[sum(v * e[t] for t, v in d.items()) / (a * b) for e, b in zip(direct, norm)] for d, a in zip(direct, norm)])
    f, w = toxicity.unit_rows(words)
    dense = np.zeros((len(words), toxicity.FEATURES), np.float32)
    for i in range(len(words)):
        np.add.at(dense[i], f[i], w[i])
    assert np.abs(dense @ dense.T - full).max() < 1e-4
    marks, z, triangle = toxicity.landmarks(f, w, np.ones(len(words)), most=len(words))
    assert (z[:, -1] == 1).all()
    z = z[:, :-1]
    assert np.abs(z @ z.T - full).max() < 0.02  # all words as landmarks: the Nyström coordinates give the kernel back
    beta = np.random.default_rng(0).normal(size=z.shape[1])
    per_mark = np.linalg.solve(triangle.T, beta)
    folded = np.zeros(toxicity.FEATURES)
    np.add.at(folded, f[marks], w[marks] * per_mark[:, None])
    want = full[:, marks] @ per_mark + 0.25
    got = toxicity.Machine(folded.astype(np.float32), 0.25, 1.0, 0.0).margins(words)
    short = [len(toxicity.TRIM.sub("", x)) == len(x) for x in words]  # margins look at trimmed tokens
    assert np.abs(got - want)[short].max() < 1e-2 * max(1, np.abs(per_mark).max())


def test_toxicity_joins_short_pieces():
    for text, word in (("an ID iot here", "idiot"), ("mo - r - on", "moron"), ("st up id", "stupid"), ("x\nscu  m", "scum")):
        assert word in toxicity.tokens(text), text
    # whole words of four characters and more, longer gaps and lengths out of range are not joined
    assert toxicity.tokens("path etic, lo ----- ser") == {"path", "etic,", "lo", "-----", "ser"}
    assert toxicity.tokens("a b") == {"a", "b"}
    assert toxicity.tokens("") == toxicity.tokens(" \n") == set()
    bags = [sorted(toxicity.tokens(f"plain talk number {i} of the day")) for i in range(60)]
    machine = toxicity.fit([*bags, *(b + ["fuzwit"] for b in bags)], [0] * 60 + [1] * 60)
    got = [machine.score(max(machine.margins(sorted(toxicity.tokens(t))))) for t in ("you fuz wit", "you fuz - wit", "talk of the day")]
    assert [g >= 0.5 for g in got] == [True, True, False]


def test_toxicity_repeated_ids_and_long_texts(spark):
    texts = [f"some good clean talk words here {i}" for i in range(40)] + [f"some fuzzwit talk {i}" for i in range(40)]
    df = docs(spark, texts).unionByName(docs(spark, ["some other talk"] * 3, start=0))
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    first, second = (toxicity.train(df.repartition(n), labels) for n in (1, 7))
    assert np.array_equal(first.weights, second.weights)
    long = docs(spark, ["good clean words here " * 40_000, "good clean words here " * 40_000 + "f - u - z - z - w - i - t"])
    assert [r.score >= 0.5 for r in toxicity.score(long, first).orderBy("doc_id").collect()] == [False, True]


def test_toxicity_learns_rare_insults():
    rng = random.Random(6)
    syllables = "th er on an re he in ed nd ha st ou le is it ar te se".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    common = ["fuzzwit", "gloopbag", "mudskull"]
    rare = ["vlokjar", "bwyxum", "qipplod", "zukfrump", "jomgwyk", "kruvbax", "pfyzgol", "wompkyx", "xubvlig", "yakzump", "gryffok", "cvumpaz"]
    # 500 toxic documents, of which each rare insult marks 3 (0.6 %), together 7.2 %
    marks = [r for r in rare for _ in range(3)] + [rng.choice(common) for _ in range(464)]
    bags = [{m, *(word() for _ in range(30))} for m in marks] + [{word() for _ in range(30)} for _ in range(1500)]
    machine = toxicity.fit(bags, [1] * 500 + [0] * 1500)
    fresh = lambda m: machine.score(float(machine.margins(sorted({m, *(word() for _ in range(30))})).max()))
    assert sum(fresh(r) >= 0.5 for r in rare) >= 11
    assert all(fresh(x) >= 0.5 for x in common) and sum(fresh("there") >= 0.5 for _ in range(100)) <= 2


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count(F.lit(1))).first()
    assert n > 50 and right >= 0.9


# --- nearest neighbours


def test_ann_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[300:420] = x[0]  # a hot vector
    rows = [(i, v.tolist(), 3, "c") for i, v in enumerate(x)]
    odd = [(1000, None, 0, "c"), (1001, [0.0] * 12, 0, "c"), (1002, [float("nan")] * 12, 0, "c"), (1003, [1.0, None] + [0.0] * 10, 0, "c"), (None, x[1].tolist(), 0, "c"), rows[7]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, leaf string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = x.astype(np.float64)
    hit = 0
    for q in range(0, 600, 50):
        score = (u * u[q]).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(u[q]))
        score[q] = -9
        best = np.lexsort((np.arange(600), -np.round(score, 12)))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in mine)
        hit += len({m[1] for m in mine} & set(best.tolist()))
    assert hit >= 0.9 * 60
    assert [m[1] for m in sorted(got[0])] == [300, 301, 302, 303, 304] and [m[1] for m in sorted(got[300])][0] == 0
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert [r.vec_id for r in ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()] and ann.nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_ann_recall_when_the_sample_is_a_tenth(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24)) * 1.5
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    report, got = {}, {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, sample_rows=600, report=report).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        score = u @ u[q]
        score[q] = -9
        hit += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert hit >= 0.9 * 5 * 120 and report["visits"] < report["leaves"]


def test_ann_keeps_the_smallest_ids_of_many_parallel_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-8, 8, 12).astype(float)
    ids = rng.permutation(600)
    # 60 vectors of one direction, scaled by powers of two so that their scores are equal, among 540 others in one leaf
    rows = [(int(i), (v * 2.0 ** (n - 30) if n < 60 else rng.normal(size=12)).tolist()) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    tied = sorted(ids[:60].tolist())
    got = {}
    for r in ann.nearest(df, F.col("vec_id").isin(tied), sample_rows=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in tied:
        assert [i for _, i in sorted(got[q])] == [i for i in tied if i != q][:5]


# --- subword pieces


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = [None, "", " ", " " * 37, "a" * 3000, "the" * 2000, "日本" * 800, "<s>a</s>", "x" + " " * 300, "▁ ▁"]
    for letters in ("abcdeinrst  ▁éèßü日本語한𝒳\n\t\r .,!0123<>∆🙂", "in er  the▁ at", "ab     ▁  \n"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    got = {r.doc_id: r for r in pieces.encode(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids)
    short = pieces.encode(docs(spark, ["a b"]), path, digest=True).first()
    assert short.ids_sha256 == sha(",".join(map(str, lib.encode("a b"))))
    assert pieces.encode(docs(spark, []), path).count() == 0


# --- near duplicates


def groups(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_neardup_equals_brute_force(spark, size):
    rng = random.Random(size)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = [None, "", " \n", "One", "one", "ONE two", "one two", "É", "é"]
    base = fresh(120)
    for k in range(60):  # a large group of copies that drift from each other
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
        texts.append(" ".join(w))
    passage = fresh(30)
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(30)]
    texts += [texts[20]] * 5 + [" ".join(fresh(200))]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in neardup.link(df, size, 80).collect()}
    root, n = groups(texts, size, 80)
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == root
    stay = neardup.keep(df, size, 80)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(root)) and stay.columns == df.columns
    assert neardup.link(docs(spark, [])).count() == 0


def test_neardup_large_sets_and_large_buckets_equal_brute_force(spark, monkeypatch):
    """Sets beyond SMALL, buckets beyond BLOCK (made small here), hot keys, and many documents that share one passage."""
    rng = random.Random(8)
    monkeypatch.setattr(neardup, "BLOCK", 12)
    monkeypatch.setattr(neardup, "HOT_ROWS", 8)
    monkeypatch.setattr(neardup, "HOT_KEYS", 1 << 20)
    fresh = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    texts = []
    for size, most, count in ((400, 60, 40), (120, 14, 60)):  # copies that drift from each other, over and under SMALL
        base = fresh(size)
        for _ in range(count):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(size)] = f"w{rng.randrange(9000)}"
            texts.append(" ".join(w))
    for own, shared, count in ((100, 300, 60), (15, 75, 60), (12, 110, 50)):  # a passage in many documents, unlinked or nearly linked
        passage = fresh(shared)
        texts += [" ".join(fresh(own // 2) + passage + fresh(own - own // 2)) for _ in range(count)]
    rng.shuffle(texts)
    df = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in neardup.link(df, 2, 80).collect()}
    root, _ = groups(texts, 2, 80)
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) > 100


def test_neardup_keeps_rows_without_an_id(spark):
    rows = [(3, "a b c"), (None, "a b c"), (7, "A b c"), (None, None), (5, None), (9, "x y"), (9, "x y"), (9, "p q r s")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, named string")
    got = sorted(map(tuple, neardup.digest(df).collect()), key=str)
    want = [(3, 2, 3, True), (None, 2, None, True), (7, 2, 3, False), (None, 0, None, True), (5, 0, 5, True), (9, 1, 9, True), (9, 1, 9, True), (9, 3, 9, True)]
    assert got == sorted(want, key=str)
    assert neardup.keep(df, 2, 80).count() == 7


def test_neardup_keys_guarantee_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, neardup.SLOTS).astype(np.uint16)
    for _ in range(300):
        b = a.copy()
        b[rng.choice(neardup.SLOTS, neardup.most_errors(0.8), replace=False)] ^= 1
        assert set(neardup.keys_of(a[None])[0]) & set(neardup.keys_of(b[None])[0])


# --- WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "u\r\nv", None), (4, "", ""), (5, "x", "é" * 5000), (6, "y", "one"), (6, "y", "one"), (None, "z", "same")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, sha1 string")
    bundles = warc.archive(df)
    got = sorted(((r.record_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_bundles(bundles).collect()), key=str)
    want = [(-1, "response", None, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 10000), (6, "response", None, 3), (6, "response", None, 3)]
    assert got == sorted(want, key=str)
    hit = warc.fetch(bundles, spark.createDataFrame([(5,), (77,)], "record_id long")).collect()
    assert [r.record_id for r in hit] == [5] and warc.parse(bytes(hit[0].record))[2] == ("é" * 5000).encode()
    assert warc.read_bundles(warc.archive(df.limit(0))).count() == 0


def test_warc_records_are_valid_and_stored_in_seekable_files(spark):
    import zstandard

    pages = [(i, f"http://h/{i % 3}", f"page {i % 5}") for i in range(40)] + [(7, "http://h/1", "page 2")]
    bundles = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    raw = b""
    for r in bundles.collect():
        store, path = warc.opened(r.bundle)
        with store.open_input_file(path) as file:
            whole = file.read()
            frames = warc.read_seek_table(file)
        assert frames == list(zip(r.frame_offset, r.frame_size, strict=True)) and sum(n for _, n in frames) < len(whole)
        raw += zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()  # any reader skips the footer
    ids, at, n = set(), 0, 0
    while at < len(raw):  # as any WARC reader goes through the plain stream
        assert raw.startswith(b"WARC/1.1\r\n", at)
        fields, _ = warc.headers(raw[at : raw.index(b"\r\n\r\n", at) + 4])
        body = raw.index(b"\r\n\r\n", at) + 4
        at = body + int(fields["Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n" and raw.startswith(b"HTTP/1.1 200", body)
        at, n = at + 4, n + 1
        assert re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z", fields["WARC-Date"]) and fields["WARC-Target-URI"]
        assert ("WARC-Profile" in fields) == (fields["WARC-Type"] == "revisit") and fields["Content-Type"].startswith("application/http")
        ids.add(fields["WARC-Record-ID"])
    assert n == len(ids) == len(pages)


# --- packing


def test_packing(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([1, 5, 40, 200, 511, 512, 700, 4096, 9000])) for i in range(400)] + [(1, 5)] * 3 + [(900, 0), (901, None), (902, -4)]
    df = spark.createDataFrame([(*x, "c") for x in items], "doc_id long, length long, bin_id string")
    got = packing.pack(df, shard_units=60_000).collect()
    total = Counter()
    bins = {}
    for r in got:
        total[r.doc_id] += r.length
        bins.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.length))
    want = Counter()
    for i, n in items:
        want[i] += max(n or 0, 0)
    assert total == +want
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= at)
    assert len({b for b, _ in bins}) == len(bins)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack_documents(docs(spark, [None, "", "a b c"])).collect()[0].length == 3
    long = packing.pack_documents(docs(spark, ["w " * 50_000])).collect()
    assert sum(r.length for r in long) == 50_000 and max(r.length for r in long) == 4096
    which, offset, used = packing.best_fit([6, 5, 3, 2], (8,), 8)
    assert (which, offset, used) == ([0, 1, 1, 0], [0, 0, 5, 6], [8, 8])


def plain_best_fit(lengths, capacities):
    """The policy in the plainest way: every floor, every open bin looked at; least summed capacity after downsizing."""
    results = []
    for floor in capacities:
        bins = []  # [capacity, used, pieces]
        for i, n in enumerate(lengths):
            fits = [b for b in bins if b[0] - b[1] >= n]
            if fits:
                b = min(fits, key=lambda b: (b[0] - b[1], bins.index(b)))
            else:
                b = [min(c for c in capacities if c >= max(n, floor)), 0, []]
                bins.append(b)
            b[1] += n
            b[2].append(i)
        results.append((sum(min(c for c in capacities if c >= b[1]) for b in bins), -floor, [b[2] for b in bins]))
    return min(results)


def least_capacity(lengths, capacities):
    """The least summed capacity of any packing, by trying every assignment."""
    best = [float("inf")]

    def go(i, used):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= u) for u in used))
            return
        for b in range(len(used)):
            if used[b] + lengths[i] <= capacities[-1]:
                go(i + 1, [*used[:b], used[b] + lengths[i], *used[b + 1 :]])
        go(i + 1, [*used, lengths[i]])

    go(0, [])
    return best[0]


def test_packing_against_exhaustive_search():
    rng = random.Random(4)
    over = []
    for _ in range(120):
        capacities = tuple(sorted(rng.sample(range(3, 30), 3)))
        lengths = sorted((rng.randint(1, capacities[-1]) for _ in range(rng.randint(1, 7))), reverse=True)
        which, _, final = packing.pack_lengths(lengths, capacities)
        cost, _, bins = plain_best_fit(lengths, capacities)
        assert final.sum() == cost and [sorted(i for i, b in enumerate(which) if b == k) for k in range(len(final))] == bins
        over.append(final.sum() / least_capacity(lengths, capacities))
    assert min(over) >= 1 and np.mean(over) <= 1.1


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "pii", "packing"]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before, df = df, stage(spark, df, sf)
        assert df.columns == before.columns and 0 < df.count() <= before.count(), name
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    root, _ = groups(texts, 5, 80)
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert got.columns == docs(spark, []).columns
