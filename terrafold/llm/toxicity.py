"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two tokens by the subsequences of three characters that they share within a span of five, each
weighted by its gaps, so ``id-iot`` and ``i.d.i.o.t`` stay close to the plain word. A text is a bag of tokens, of words
spelt out over several tokens and of neighbouring short pieces (``id iot``) joined, and as toxic as its worst one. Labels mark bags: each round trains on the token of every toxic bag that the machine so far
takes for its worst (and copies of it with inserted characters) against tokens of clean bags, the hardest included, in
the space that the landmarks span; no toxic bag is left out, and the machine's penalty bears with wrong labels.
As the kernel has a finite feature map, the trained machine folds into one weight a feature, and a task scores each
distinct token once.

The machine is fitted on a bounded sample of labelled rows (``BAGS`` toxic documents, ``CLEAN_SHARE`` times as many clean
ones); every row is scored over its whole text. Null and blank texts score 0; with labels of one class only, or none, every text gets that class's constant score
(0 for none); repeated rows score alike, and of rows that repeat an id the least bag of tokens trains; null labels and labels without a document are left out; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Labelled toxic documents that the machine is fitted on, about.
BAGS = 1000
#: Landmarks, clean tokens drawn for training, rounds, decay of a gap, penalty of a wrong side.
LANDMARKS, CLEAN, ROUNDS, DECAY, COST = 448, 9_000, 4, 0.6, 100_000.0
#: Worst tokens, the commonest first, that get copies with inserted characters.
BENT = 150
#: One bag in so many places the border.
FOLDS = 5
#: Clean labelled documents for each toxic one.
CLEAN_SHARE = 4
#: Offsets of the second and third character of a subsequence from its first, and the weight of their gaps.
SHAPES = [(j, k, DECAY ** (k - 2)) for k in range(2, 5) for j in range(1, k)]
GAPS = np.array([w for *_, w in SHAPES], np.float32)
FEATURES, WIDTH, EDGE = 1 << 21, 32, 127
#: Tokens whose score a task keeps, and texts that it takes at a time.
MEMO, STRIDE = 200_000, 200
#: Single characters parted by up to four others, as in ``i d i o t`` or ``i - d - i - o - t``.
SPELT = re.compile(r"(?<!\w)(?:\w[\W_]{1,4}){3,}\w(?!\w)")
#: Runs of pieces of at most three characters parted by up to four others, as in ``id iot`` or ``mo - r - on``, the
#: pieces, how many neighbours of a run are joined, and the lengths of what they are joined to.
RUN = re.compile(r"\b\w{1,3}\b(?:\W{1,4}\w{1,3}\b)+")
PIECE = re.compile(r"\w+")
PIECES, JOINED = (2, 3), range(4, 10)
TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens of a text, spelt-out words and neighbouring short pieces joined among them."""
    low = text.lower()
    out = set(low.split())
    for m in RUN.finditer(low):
        pieces = PIECE.findall(m.group())
        for n in PIECES:
            out.update(w for i in range(len(pieces) - n + 1) if len(w := "".join(pieces[i : i + n])) in JOINED)
    for m in SPELT.finditer(low):
        out.add(re.sub(r"[\W_]+", "", m.group()))
    return out


def windows(token: str) -> list[str]:
    """The trimmed token, in overlapping windows if it is long."""
    token = TRIM.sub("", token)
    if len(token) <= WIDTH:
        return [token]
    return [token[i : i + WIDTH] for i in range(0, len(token) - WIDTH // 4, WIDTH * 3 // 4)]


def code_table() -> np.ndarray:
    """Code of each code point: 1-26 for a-z, 27-123 for other letters and digits, 124 for the rest."""
    table = np.full(1 << 16, 124, np.int32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            table[c] = 27 + c % 97
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0] = 0
    return table


CODES = code_table()


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and weight of each subsequence of each word (rows padded with feature 0 and weight 0)."""
    longest = max(map(len, words), default=0)
    raw = np.array(words, dtype=f"U{max(longest, 1)}").view(np.uint32).reshape(len(words), -1)
    size = (raw > 0).sum(1)
    c = np.zeros((len(words), raw.shape[1] + 6), np.int32)
    c[:, 1 : raw.shape[1] + 1] = CODES[np.minimum(raw, 0xFFFF)]
    c[:, 0] = EDGE
    c[np.arange(len(words)), size + 1] = EDGE
    n = raw.shape[1]
    ids, weights = [], []
    for j, k, w in SHAPES:
        last = c[:, k : k + n]
        ids.append((c[:, :n] << 14) | (c[:, j : j + n] << 7) | last)
        weights.append(np.where(last > 0, np.float32(w), np.float32(0)))
    f, w = np.concatenate(ids, 1), np.concatenate(weights, 1)
    return np.where(w > 0, f, 0), w


def featurise(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of each word (rows padded with weight 0); equal features of a word are summed."""
    f, w = occurrences(words)
    order = np.argsort(f, axis=1, kind="stable")
    f, w = np.take_along_axis(f, order, 1), np.take_along_axis(w, order, 1)
    # sum equal neighbours into the last of each run
    total = np.cumsum(w, axis=1)
    end = np.ones(f.shape, bool)
    end[:, :-1] = f[:, 1:] != f[:, :-1]
    upto = np.where(end, total, 0)
    before = np.zeros_like(upto)
    before[:, 1:] = np.maximum.accumulate(upto, axis=1)[:, :-1]
    w = np.where(end, total - before, 0).astype(np.float32)
    return f, np.where(f > 0, w, 0)


def squared_lengths(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared length of each word's features once equal ones are summed, given its occurrences.

    To the squares of all occurrences come twice the products of those that share a feature; in sorted order these are
    neighbours, found one distance after the other among the words that still have some.
    """
    out, kind = (w * w).sum(1), np.repeat(np.arange(len(SHAPES), dtype=np.int32), f.shape[1] // len(SHAPES))
    ordered, rows = np.sort(f << 4 | kind, axis=1), np.arange(len(f))
    for apart in range(1, f.shape[1]):
        one, two = ordered[:, :-apart], ordered[:, apart:]
        same = (one >> 4 == two >> 4) & (two > 15)
        some = same.any(1)
        if not some.any():
            break
        ordered, rows, same = ordered[some], rows[some], same[some]
        out[rows] += 2 * (GAPS[ordered[:, :-apart] & 15] * GAPS[ordered[:, apart:] & 15] * same).sum(1)
    return out


@dataclass
class Machine:
    weights: np.ndarray  # of each feature, after folding
    bias: float
    slope: float  # of the calibration
    shift: float

    def margins(self, toks: list[str]) -> np.ndarray:
        """Margin of each token: that of its worst window."""
        flat = [t if t.isalnum() else TRIM.sub("", t) for t in toks]
        owner = list(range(len(toks)))
        for i in [i for i, t in enumerate(flat) if len(t) > WIDTH]:  # scored by their windows, not as a whole
            parts = windows(flat[i])
            flat += parts
            owner += [i] * len(parts)
        out, owner = np.full(len(toks), -np.inf), np.array(owner, np.int64)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, WIDTH)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(rows), 5_000):
                part = rows[at : at + 5_000]
                f, w = occurrences([flat[i] for i in part])
                norm = np.sqrt(np.maximum(squared_lengths(f, w), 1e-9))
                np.maximum.at(out, owner[part], (self.weights[f] * w).sum(1) / norm + self.bias)
        return np.where(np.isfinite(out), out, self.bias)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def unit_rows(words: list[str], step: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """``featurise`` with rows of length one, a few words at a time so that little memory is held."""
    parts = [featurise(words[at : at + step]) for at in range(0, len(words), step)] or [featurise([])]
    width = max(f.shape[1] for f, _ in parts)
    ids, weights = np.zeros((len(words), width), np.int32), np.zeros((len(words), width), np.float32)
    for at, (f, w) in zip(range(0, len(words), step), parts, strict=False):
        ids[at : at + len(f), : f.shape[1]] = f
        weights[at : at + len(f), : f.shape[1]] = w / np.sqrt(np.maximum((w * w).sum(1, keepdims=True), 1e-9))
    return ids, weights


def landmarks(f: np.ndarray, w: np.ndarray, weight: np.ndarray, most: int = LANDMARKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Landmark rows, the Nyström coordinates of all rows with a last column of ones, and the triangle that maps kernels to coordinates.

    Each landmark is the row that the ones before explain least, by weight: a pivoted Cholesky factor of the kernel.
    """
    left, z, marks = np.ones(len(f)), np.zeros((len(f), most + 1)), []
    held = w > 0
    held[:, :1] = True  # so that no row is without an entry
    ends = np.cumsum(held.sum(1))
    starts, flat = np.append(0, ends[:-1]), w[held]
    kinds, place = np.unique(f[held], return_inverse=True)
    spread = np.zeros(len(kinds), np.float32)
    for m in range(min(most, len(f))):
        pick = int(np.argmax(left * weight))
        if left[pick] < 1e-4:
            break
        own = slice(starts[pick], ends[pick])
        np.add.at(spread, place[own], flat[own])
        column = np.add.reduceat(spread[place] * flat, starts, dtype=np.float64) - z[:, :m] @ z[pick, :m]
        spread[place[own]] = 0
        z[:, m] = column / np.sqrt(left[pick])
        left = np.maximum(left - z[:, m] ** 2, 0)
        left[pick] = 0
        marks.append(pick)
    picked = np.array(marks, np.int64)
    z[:, len(marks)] = 1  # the bias, kept beside the coordinates
    return picked, z[:, : len(marks) + 1], np.tril(z[picked, : len(marks)])


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 14) -> np.ndarray:
    """Weights of the linear machine on z (its last column is the bias) by Newton steps on the active rows."""
    d = z.shape[1]
    beta, ridge = np.zeros(d), np.eye(d)
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        live = np.flatnonzero(y * (z @ beta) < 1)
        square, side = ridge.copy(), np.zeros(d)
        for at in range(0, len(live), 2_000):
            rows = live[at : at + 2_000]
            a = z[rows] * cost[rows, None]
            square += a.T @ z[rows]
            side += a.T @ y[rows]
        new = np.linalg.solve(square, side)
        done = np.abs(new - beta).max() < 1e-6
        beta = new if done else beta + (new - beta) * 0.9
        if done:
            break
    return beta


def gapped(word: str, rng: np.random.Generator) -> list[str]:
    """Copies of a word with one separator, separators throughout, one doubled and one foreign letter."""
    if len(word) < 3:
        return []
    i = int(rng.integers(1, len(word)))
    other = chr(97 + int(rng.integers(26)))
    return [word[:i] + "-" + word[i:], ".".join(word), word[:i] + word[i - 1] + word[i:], word[:i] + other + word[i:]]


def without_copies(bags: list[np.ndarray], labels: np.ndarray, words: list[str], rng: np.random.Generator) -> list[int]:
    """One bag of each group of near copies with one label: those that share one of ten runs of six least hashes."""
    base = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    odd = rng.integers(1, 1 << 31, 60, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    root = list(range(len(bags)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[tuple, int] = {}
    for i, b in enumerate(bags):
        if len(b):
            least = ((base[b][:, None] * odd) >> np.uint64(16) & np.uint64(0xFFFFFFFF)).min(0).reshape(10, 6)
            for run, values in enumerate(least.tolist()):
                j = first.setdefault((int(labels[i]), run, *values), i)
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [i for i in range(len(bags)) if find(i) == i]


def document_counts(bags: list[np.ndarray], n: int) -> np.ndarray:
    """In how many bags each token is."""
    out = np.zeros(n)
    for b in bags:
        out[b] += 1
    return out


def first_guess(words: list[str], toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """How much more often a token and its features occur in toxic bags than in clean ones, as log odds."""
    seen = [np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32)]
    for kind, group in enumerate((clean, toxic)):
        for b in group:
            f, w = featurise([words[i] for i in b])
            seen[kind][np.unique(f[w > 0])] += 1
    odds = np.log((seen[1] + 0.5) / (len(toxic) + 1)) - np.log((seen[0] + 0.5) / (len(clean) + 1))
    tokens_seen = [document_counts(group, len(words)) for group in (clean, toxic)]
    out = np.log((tokens_seen[1] + 0.5) / (len(toxic) + 1)) - np.log((tokens_seen[0] + 0.5) / (len(clean) + 1))
    for at in range(0, len(words), 3_000):
        f, w = unit_rows(words[at : at + 3_000])
        out[at : at + 3_000] += (odds[f] * (w * w)).sum(1)
    return out


def learned(words: list[str], index: list[np.ndarray], y: np.ndarray, own: list[int], rng: np.random.Generator, rounds: int) -> Machine:
    """The machine of the bags ``own``, its margin not yet calibrated.

    Each round's positives are the tokens that the machine so far takes for the worst of some toxic bag, as heavy as
    such bags are many; negatives are tokens of clean bags, those the machine takes for worst among them.
    """
    toxic = [index[i] for i in own if y[i] == 1 and len(index[i])]
    clean = [index[i] for i in own if y[i] == 0 and len(index[i])]
    in_clean = document_counts(clean, len(words))
    margin = first_guess(words, toxic, clean)
    clean_words = np.flatnonzero(in_clean > 0)
    frequent = clean_words[np.argsort(-in_clean[clean_words], kind="stable")[: CLEAN // 3]]
    pool = np.union1d(frequent, rng.choice(clean_words, min(len(clean_words), CLEAN // 3), replace=False))
    for _ in range(rounds):
        hard = clean_words[np.argsort(-margin[clean_words], kind="stable")[: CLEAN // 4]]
        pool = np.union1d(pool, hard)
        worst, counts = np.unique([i[np.argmax(margin[i])] for i in toxic], return_counts=True)
        against = np.setdiff1d(pool, worst)
        good = [words[i] for i in worst]
        common = np.argsort(-counts, kind="stable")[:BENT]
        bent = sorted({v for i in common for v in gapped(good[i], rng)}.difference(words))
        train = [*good, *bent, *(words[i] for i in against)]
        sign = np.array([1.0] * (len(good) + len(bent)) + [-1.0] * len(against))
        weight = np.concatenate([np.clip(counts, 1, 20), np.full(len(bent), 1.0), np.clip(in_clean[against], 1, 20)])
        weight[sign > 0] *= weight[sign < 0].sum() / weight[sign > 0].sum() / 4
        tf, tw = unit_rows(train)
        marks, z, triangle = landmarks(tf, tw, np.sqrt(weight))
        beta = squared_hinge(z, sign, weight * COST / weight.sum())
        per_mark = np.linalg.solve(triangle.T, beta[:-1])
        folded = np.zeros(FEATURES)
        np.add.at(folded, tf[marks], tw[marks] * per_mark[:, None])
        machine = Machine(folded.astype(np.float32), float(beta[-1]), 1.0, 0.0)
        margin = np.concatenate([machine.margins(words[at : at + 50_000]) for at in range(0, len(words), 50_000)])
    return machine


def tops(machine: Machine, words: list[str], index: list[np.ndarray]) -> np.ndarray:
    """Margin of each bag: that of its worst token."""
    margin = np.concatenate([machine.margins(words[at : at + 50_000]) for at in range(0, max(len(words), 1), 50_000)])
    return np.array([margin[i].max() if len(i) else machine.bias for i in index])


def ends(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The highest clean and the lowest toxic margins, a few on each side aside."""
    return float(np.quantile(top[y == 0], 0.995)), float(np.quantile(top[y == 1], 0.03))


def border_share(top: np.ndarray, y: np.ndarray, held: np.ndarray) -> float:
    """Where between the ends of the other bags the border does least wrong on the held ones: the middle of the best places."""
    low, high = ends(top[~held], y[~held])
    places = np.linspace(0.1, 0.9, 33)
    wrong = [(top[held & (y == 1)] < low + (high - low) * p).mean() + (top[held & (y == 0)] >= low + (high - low) * p).mean() for p in places]
    return float(places[np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)].mean())


def fit(bags: Iterable[Iterable[str]], labels: list[int], seed: int = 7) -> Machine:
    """The machine from bags of tokens, each read once, and their labels; both classes occur.

    The border is placed by a fold of the training bags: a machine of the others judges it.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    index = []
    for bag in bags:
        held = {vocabulary.setdefault(w, len(vocabulary)) for t in bag for w in windows(t) if w}
        index.append(np.array(sorted(held), np.int32))
    words, y = list(vocabulary), np.array(labels)
    own = without_copies(index, y, words, rng)
    share = 0.5
    fold = {k: own_k[::FOLDS] for k in (0, 1) if len(own_k := [i for i in own if y[i] == k and len(index[i])]) >= 2 * FOLDS}
    if len(fold) == 2:
        aside = np.zeros(len(own), bool)
        aside[np.isin(own, fold[0] + fold[1])] = True
        first = learned(words, index, y, [i for i, a in zip(own, aside, strict=True) if not a], rng, 2)
        share = border_share(tops(first, words, [index[i] for i in own]), y[own], aside)
    machine = learned(words, index, y, own, rng, ROUNDS)
    top = tops(machine, words, index)
    slope, _ = calibrate(top, y)
    low, high = ends(top, y)
    if high > low:
        border = low + (high - low) * share
    else:  # the classes overlap: the border with the fewest wrong training bags
        x = np.sort(top)
        best = int(np.argmin([((top >= b) != (y == 1)).sum() for b in x]))
        border = (x[best] + x[max(best - 1, 0)]) / 2
    return Machine(machine.weights, machine.bias, slope, -slope * border)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with smoothed targets, classes weighing alike."""
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (p - target) * x).sum() + 1e-4 * (a - 1), (weight * (p - target)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - step[0], 0.1), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bags: int = BAGS) -> Machine | float:
    """Fit on about ``bags`` toxic and ``CLEAN_SHARE`` times as many clean labelled documents, drawn by a hash of the id; a constant for one class."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return float(next(iter(n), 0))
    steps = 1_000_000
    rate = F.when(F.col("y") == 1, min(1.0, bags / n[1])).otherwise(min(1.0, CLEAN_SHARE * bags / n[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < rate * steps).limit(2 * (1 + CLEAN_SHARE) * bags)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "bag": ["\n".join(sorted(tokens(t))) for t in pdf["text"]]})

    # The drawn labels are bounded by the parameter, so they are broadcast.
    texts = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = texts.mapInPandas(gather, "doc_id long, y int, bag string").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("bag").alias("bag")).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    found = set(rows["y"])
    if len(found) < 2:
        return float(next(iter(found), 0))
    return fit(([t for t in b.split("\n") if t] for b in rows["bag"]), rows["y"].tolist())


def scores(texts: Iterator[pd.Series], state: tuple) -> Iterator[list[float]]:
    """The score of each text of each batch; a few texts at a time, so that memory stays bounded by ``MEMO``."""
    machine, memo = Machine(*state), {}
    for batch in texts:
        out: list[float] = []
        for at in range(0, len(batch), STRIDE):
            bags = [tokens(t) for t in batch.iloc[at : at + STRIDE]]
            if len(memo) > MEMO:
                memo.clear()
            new = list(set().union(*bags).difference(memo))
            for i in range(0, len(new), 20_000):
                memo.update(zip(new[i : i + 20_000], machine.margins(new[i : i + 20_000]).tolist(), strict=True))
            out += [machine.score(max(map(memo.__getitem__, b))) if b else 0.0 for b in bags]
        yield out


def scored(docs: DataFrame, machine: Machine | float, text_col: str = "text") -> Column:
    """The score of each row's whole text."""
    if isinstance(machine, float):
        return F.lit(machine)
    state = docs.sparkSession.sparkContext.broadcast((machine.weights, machine.bias, machine.slope, machine.shift))

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for out in scores(texts, state.value):
            yield pd.Series(out, dtype="float64")

    return of(whole(F.col(f"`{text_col}`")))


def score(docs: DataFrame, machine: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row's whole text."""
    return docs.select(id_col, scored(docs, machine, text_col).alias("score"))


def keep(docs: DataFrame, machine: Machine | float, text_col: str = "text") -> DataFrame:
    """The documents that score under 0.5, with their columns."""
    return docs.where(scored(docs, machine, text_col) < 0.5)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a machine that never saw the held-out fifth."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    machine = train(docs, labels.where(~held))
    return score(docs.select("doc_id", "text"), machine).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
