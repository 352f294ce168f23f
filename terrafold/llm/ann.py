"""Nearest neighbours by cosine with a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample of distinct unit vectors; every vector is then indexed in the leaf that it
descends to. A query takes leaves from a priority queue of tree nodes, the nearest centre first, and visits as many as
the calibration found necessary: for ``PROBES`` vectors outside the sample (inside, if there are no others) one pass over
the whole index finds their true neighbours, and the visits widen until ``RECALL`` of these lie in visited leaves.
Visits also go on until the leaves hold enough candidates.

Equal vectors tie on every score, so of each distinct vector only the smallest ``k + 1`` ids can be results; the rest
leaves before the search, in the window's partial limit, and equal queries are searched once. Neighbouring leaves form
groups of about ``BLOCK_ROWS`` rows, so a query's vector goes along once a group and not once a leaf; a larger leaf, or a
group with many queries, is cut into blocks, and each pair of blocks is one task's group; nothing is capped.

Vectors that are null, zero, of another length than the sample's, or with null or non-finite components take no part;
null ids neither. Ties go to the smaller id; repeated rows (same id and vector) count as one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, temporary, written

#: Rows of the sample that the tree is fitted on, about; branches of a node; sample rows of a leaf at most.
SAMPLE_ROWS, BRANCHES, LEAF_ROWS = 12_000, 8, 48
#: Recall that the calibration must reach, on so many probes.
RECALL, PROBES = 0.94, 300
#: Candidates and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8_000, 1_000


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes; node 0 is the root
    children: list[list[int]]  # empty for a leaf

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector descends to."""
        at = np.zeros(len(unit), np.int64)
        live = np.arange(len(unit)) if self.children[0] else np.zeros(0, np.int64)
        while len(live):
            nodes = at[live]
            for node in np.unique(nodes):
                rows = live[nodes == node]
                kids = np.array(self.children[node])
                at[rows] = kids[np.argmax(unit[rows] @ self.centres[kids].T, axis=1)]
            live = live[[bool(self.children[n]) for n in at[live]]]
        return at

    def visits(self, near: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order for a query's nearness to all centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                best = max(kids, key=lambda c: near[c])
                for c in kids:
                    if c != best:
                        heapq.heappush(queue, (-near[c], c))
                node = best
            yield node

    def leaves(self) -> list[int]:
        """All leaves, those of one branch side by side."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            stack += self.children[node]
            if not self.children[node]:
                out.append(node)
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster of each row; centres start spread out, empty clusters vanish."""
    centres = [x[rng.integers(len(x))]]
    far = np.full(len(x), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
        if far.sum() <= 1e-12:
            break
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(centres)
    for _ in range(rounds):
        label = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        c = np.array([x[label == j].mean(0) for j in np.unique(label)])
    return np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)


def fit(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Tree:
    """The tree of a sample of unit vectors."""
    rng, centres, children = np.random.default_rng(seed), [sample.mean(0)], [[]]
    work = [(0, np.arange(len(sample)))]
    while work:
        node, rows = work.pop()
        if len(rows) <= leaf_rows:
            continue
        label = k_means(sample[rows], branches, rng)
        parts = [rows[label == j] for j in np.unique(label)]
        if len(parts) < 2:
            continue
        for part in parts:
            children[node].append(len(centres))
            mean = sample[part].mean(0)
            centres.append(mean / max(np.linalg.norm(mean), 1e-12))
            children.append([])
            work.append((children[node][-1], part))
    return Tree(np.array(centres), children)


def calibrate(tree: Tree, probes: np.ndarray, truth: list[list[int]], target: float = RECALL) -> int:
    """Least number of leaf visits at which the target's share of the probes' true neighbours, given by leaf, is met."""
    found_at: list[int] = []
    for near, leaves in zip(probes @ tree.centres.T, truth, strict=True):
        order = {n: i + 1 for i, n in enumerate(tree.visits(near))}
        found_at += [order[leaf] for leaf in leaves]
    if not found_at:
        return 1
    return int(np.sort(found_at)[min(len(found_at), ceil(target * len(found_at))) - 1])


def true_leaves(indexed: DataFrame, probes: DataFrame, k: int) -> list[list[int]]:
    """The leaves of each probe's k nearest other rows; every task keeps the best of its rows for each probe."""
    rows = probes.toPandas()  # PROBES rows at most
    ids, y = rows["id"].to_numpy(), stacked(rows["v"])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    shared = indexed.sparkSession.sparkContext.broadcast((ids, y))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, y = shared.value
        score, leaf = np.zeros((len(y), 0)), np.zeros((len(y), 0), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                x = stacked(part["v"])
                s = y @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                s[own[:, None] == part["id"].to_numpy()] = -np.inf
                score, leaf = np.hstack([score, s]), np.hstack([leaf, np.broadcast_to(part["leaf"].to_numpy(), s.shape)])
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, leaf = np.take_along_axis(score, top, 1), np.take_along_axis(leaf, top, 1)
        probe = np.repeat(np.arange(len(y)), score.shape[1])
        out = pd.DataFrame({"probe": probe, "score": score.ravel(), "leaf": leaf.ravel()})
        yield out[np.isfinite(out["score"])]

    found = indexed.select("id", "v", "leaf").mapInPandas(best, "probe int, score double, leaf long")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "leaf"))).where(F.col("n") <= k)
    out: list[list[int]] = [[] for _ in ids]
    for r in top.collect():  # k rows a probe
        out[r["probe"]].append(r["leaf"])
    return out


def usable(vector: Column) -> Column:
    """Whether all components are finite and not all are zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    recall: float = RECALL,
    report: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found for each query row.

    ``report``, if given, gets the numbers of leaves in all and visited.
    """
    with temporary(vectors.sparkSession):
        found = searched(vectors, is_query, k, id_col, vector_col, sample_rows, recall, {} if report is None else report)
        return lasting(found, "ann-neighbours")[0]


def searched(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, sample_rows: int, recall: float, report: dict) -> DataFrame:
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queried = F.coalesce(is_query, F.lit(False)).alias("queried")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queried)
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"])
    same = Window.partitionBy("v").orderBy("id")
    kept = rows.select("id", "v").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    kept, _ = written(kept, "ann-vectors")

    distinct = kept.where("n = 1")
    total = distinct.count()
    steps = 1_000_000
    place, upto = F.pmod(F.xxhash64("v"), F.lit(steps)), max(1, int(steps * min(1.0, sample_rows / max(1, total))))
    got = distinct.where(place < upto).select("v").limit(2 * sample_rows).toPandas()["v"]
    if not len(got):
        got = distinct.select("v").limit(1).toPandas()["v"]
        if not len(got):
            return empty
    dim = int(np.bincount([len(v) for v in got]).argmax())
    sample = np.array([v for v in got if len(v) == dim], np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    tree = fit(sample)
    shared = spark.sparkContext.broadcast((tree.centres, tree.children))  # bounded by the sample

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = stacked(pdf["v"])
                yield pdf.assign(leaf=Tree(*shared.value).leaf_of(x / np.linalg.norm(x, axis=1, keepdims=True)))

    sized = F.size("v") == dim
    indexed, _ = written(kept.where(sized).mapInPandas(index, "id long, v array<float>, n int, leaf long"), "ann-index")
    held = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row a leaf

    # Probes come from the hashes after the sample's, around the circle, so from the sample only if that is all.
    rate = max(1, int(steps * min(1.0, 2 * PROBES / max(1, total))))
    after = F.pmod(place - F.lit(upto), F.lit(steps))
    probes = indexed.where("n = 1").where(after < rate).select("id", "v").limit(PROBES).persist()
    near_probes = stacked(probes.toPandas()["v"]).reshape(-1, dim)
    near_probes /= np.linalg.norm(near_probes, axis=1, keepdims=True)
    visits = calibrate(tree, near_probes, true_leaves(indexed, probes, k), recall)
    probes.unpersist()
    report |= {"leaves": len(held), "visits": visits, "rows": sum(held.values())}

    # Neighbouring leaves share a group as long as they fit one block.
    group_of, size = {}, {}
    for leaf in tree.leaves():
        n = held.get(leaf, 0)
        if n:
            last = len(size) - 1
            if not size or size[last] + n > BLOCK_ROWS:
                last += 1
            group_of[leaf], size[last] = last, size.get(last, 0) + n

    queries = rows.where(F.col("queried") & sized)
    asking = queries.groupBy("v").agg(F.min("id").alias("q"))
    asking, _ = written(asking, "ann-asking")
    tasks = max(1, min(10_000, asking.count() // 200))

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(*shared.value)
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                x = stacked(part["v"])
                out = []
                for q, v, near in zip(part["q"], part["v"], (x / np.linalg.norm(x, axis=1, keepdims=True)) @ tree.centres.T, strict=True):
                    seen, taken = 0, {}
                    for i, leaf in enumerate(tree.visits(near)):
                        if i >= visits and seen >= 4 * (k + 1):
                            break
                        if n := held.get(leaf, 0):
                            seen += n
                            taken.setdefault(group_of[leaf], []).append(leaf)
                    out += [(q, v, g, leaves) for g, leaves in taken.items()]
                yield pd.DataFrame(out, columns=["q", "v", "grp", "leaves"])

    asked, _ = written(asking.repartition(tasks, "q").mapInPandas(traverse, "q long, v array<float>, grp long, leaves array<long>"), "ann-queries")
    load = {r["grp"]: r["count"] for r in asked.groupBy("grp").count().collect()}  # one row a group
    blocks = [(g, -(-n // BLOCK_ROWS), -(-load[g] // BLOCK_QUERIES)) for g, n in size.items() if g in load]
    if not blocks:
        return empty
    blocks = F.broadcast(spark.createDataFrame(blocks, "grp long, rows_in int, queries_in int"))  # one row a group
    groups = F.broadcast(spark.createDataFrame(list(group_of.items()), "leaf long, grp long"))  # one row a leaf
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = indexed.join(groups, "leaf").join(blocks, "grp").select("grp", deal("id", "rows_in").alias("rb"), count("queries_in").alias("qb"), "leaf", "id", "v")
    right = asked.join(blocks, "grp").select("grp", count("rows_in").alias("rb"), deal("q", "queries_in").alias("qb"), "q", "v", "leaves")

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"q": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        own = own.sort_values("leaf", ignore_index=True)
        x, ids = stacked(own["v"]), own["id"].to_numpy()
        nx, out = np.sqrt((x * x).sum(1)), []
        leaves, rows_of = np.unique(own["leaf"], return_counts=True)
        for start in range(0, len(ask), 200):
            part = ask.iloc[start : start + 200]
            y = stacked(part["v"])
            ny = np.sqrt((y * y).sum(1))
            visited = np.repeat([np.isin(leaves, wanted) for wanted in part["leaves"]], rows_of, axis=1)
            rough = np.where(visited, (y @ x.T) / nx, -np.inf)
            best_at = len(x) - min(len(x), k + 1)
            # Rough scores differ from exact ones by rounding only, so whatever may be in the first k + 1 is kept, ties and all.
            margin = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * ny
            bound = np.partition(rough, best_at, axis=1)[:, best_at] - margin
            for i, q in enumerate(part["q"]):
                near = np.flatnonzero(visited[i] & (rough[i] >= bound[i]))
                score = (x[near] * y[i]).sum(1) / (nx[near] * ny[i])  # the same sum for equal vectors, so ties are exact
                best = np.lexsort((ids[near], -score))[: k + 1]
                out.append(pd.DataFrame({"q": q, "id": ids[near][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ["grp", "rb", "qb"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = queries.select("id", "v").join(asking, "v").select(F.col("id").alias("query_id"), "q")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = named.join(top, "q").where(F.col("query_id") != F.col("id")).withColumn("rank", F.row_number().over(final).cast("int"))
    return out.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
