"""Approximate nearest neighbours by a forest of random-projection trees.

Fit, on a bounded sample (`sample` rows, those of the smallest hashed ids): each tree
has a random direction for each level; a node splits at the median of its sample's
projections. Index: every vector of the table is read through all trees and keeps
the number of its leaf in each. Vectors are kept once, in pieces of about `piece` vectors
that are ranges of the first tree's leaves; a piece knows which leaves of which trees
it has members in.

Search: all trees of a query share one priority queue, ordered by the largest
distance to a splitting plane that the way to a node has crossed to its other side.
Nearest first, leaves are taken until they hold `budget` vectors in all (counted in
each tree by the whole table's leaf sizes). The query goes, with its leaves, once to each piece that
has members of one of them; there its candidates, the members of these leaves, are
reranked exactly by Euclidean distance in double precision, and the k nearest go on.

The budget is a share of the table. It is fitted on the sample: for `trial` of its
rows, the queue's order tells what share of the sample had to be taken to find each
of their true nearest neighbours there; the share by which `goal` of these are found is used.
Neighbours in the whole table are nearer than in a sample of it, so that the share is rather too large.
Vectors that lie in clusters take small shares; vectors that are about equally far from each
other take large ones, and nothing but a scan of most of them has a good recall there.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
components take no part. Shorter vectors count as padded with zeros. Rows that repeat a
vec_id are one vector (the smallest). Ties go to the smaller vec_id. A query has k + 1
candidates at least, or all vectors, if these are fewer. An empty table gives an empty result.
Ids are longs; only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.base import written
from loomtext.llm.topk import matrix


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): one row of doubles for each vec_id with a vector that takes part."""
    x = df[embedding].cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.where(x.isNotNull() & good & df[vec_id].isNotNull()).select(df[vec_id].cast("long").alias("vec_id"), x.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


class Forest:
    """Directions (width, trees * depth) and, for each tree and level, the thresholds of its nodes."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 12) -> None:
        self.trees, self.depth, self.leaves = trees, depth, 1 << depth
        self.directions = np.random.default_rng(seed).standard_normal((max(sample.shape[1], 1), trees * depth))
        self.thresholds = []
        projected = self.project(sample)
        for t in range(trees):
            node, levels = np.zeros(len(sample), int), []
            for level in range(depth):
                p, cuts = projected[:, t * depth + level], np.zeros(1 << level)
                order = np.lexsort((p, node))
                sizes = np.bincount(node, minlength=1 << level)
                starts = np.cumsum(sizes) - sizes
                some = np.flatnonzero(sizes)
                cuts[some] = (p[order[starts[some] + (sizes[some] - 1) // 2]] + p[order[starts[some] + sizes[some] // 2]]) / 2
                levels.append(cuts)
                node = 2 * node + (p > cuts[node])
            self.thresholds.append(levels)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Vectors longer than the sample's count by their first components here; reranking takes them whole."""
        w = min(x.shape[1], len(self.directions))
        return x[:, :w] @ self.directions[:w]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        projected, out = self.project(x), np.zeros((len(x), self.trees), np.int32)
        for t, levels in enumerate(self.thresholds):
            for level, cuts in enumerate(levels):
                out[:, t] = 2 * out[:, t] + (projected[:, t * self.depth + level] > cuts[out[:, t]])
        return out

    def taken(self, projected: np.ndarray, sizes: np.ndarray, budget: float):
        """(tree, leaf) in order of the shared queue until the leaves hold `budget` vectors; sizes: (trees, leaves)."""
        queue, held = [(0.0, t, 0, 0) for t in range(self.trees)], 0
        while queue and held < budget:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:  # down the near side; the other one waits in the queue
                margin = projected[t * self.depth + level] - self.thresholds[t][level][node]
                side = int(margin > 0)
                heapq.heappush(queue, (max(far, abs(margin)), t, level + 1, 2 * node + 1 - side))
                level, node = level + 1, 2 * node + side
            held += sizes[t, node]
            yield t, node

    def mask(self, projected: np.ndarray, sizes: np.ndarray, budget: float) -> np.ndarray:
        """One query's leaves as booleans (trees, leaves)."""
        out = np.zeros((self.trees, self.leaves), bool)
        for t, leaf in self.taken(projected, sizes, budget):
            out[t, leaf] = True
        return out

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        return np.array([np.bincount(codes[:, t], minlength=self.leaves) for t in range(self.trees)])


def nearest(q: np.ndarray, own: int | None, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest of x but the query's own, ties to smaller ids; distances from the differences of components."""
    some = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
    if len(some) > 4 * k:  # a product of matrices tells which are near; its error is far below the margin
        rough = (x[some] * x[some]).sum(1) - 2 * (x[some] @ q)
        limit = np.partition(rough, k - 1)[k - 1]
        some = some[rough <= limit + 1e-9 * (1 + abs(limit) + 2 * (q @ q))]
    d = np.sqrt(((x[some] - q) ** 2).sum(1))
    order = np.lexsort((ids[some], d))[:k]
    return some[order], d[order]


def fitted_share(forest: Forest, sample: np.ndarray, k: int, goal: float, trial: int = 200) -> float:
    """The budget, as a share of the table, by which `goal` of the true neighbours of `trial` sampled rows are found in the sample."""
    codes, projected = forest.codes(sample), forest.project(sample)
    sizes, ids, needs = forest.sizes(codes), np.arange(len(sample)), []
    for i in range(0, len(sample), max(1, len(sample) // trial)):
        places, _ = nearest(sample[i], i, sample, ids, k)
        after, held = np.full((forest.trees, forest.leaves), np.inf), 0
        for t, leaf in forest.taken(projected[i], sizes, np.inf):
            held += sizes[t, leaf]
            after[t, leaf] = held
        needs += after[np.arange(forest.trees), codes[places]].min(1).tolist()
    return float(np.quantile(needs, goal)) / len(sample) if needs else 1.0


def packed(counts: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Keys in order into numbered pieces of about `size` rows: the first piece of each key, how many it is cut into, and the number of pieces."""
    first, cuts, number, held = {}, {}, 0, 0
    for key in sorted(counts):
        n = counts[key]
        if held and held + n > size:
            number, held = number + 1, 0
        first[key], cuts[key], held = number, max(1, -(-n // size)), held + n
        if n > size:
            number, held = number + cuts[key], 0
    return first, cuts, number + (held > 0)


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def search(found: DataFrame, is_query: Column, k: int = 10, trees: int = 32, leaf: int = 100, deepest: int = 9, sample: int = 20_000, goal: float = 0.96, piece: int = 1 << 14, query_block: int = 4096, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, v); `is_query` is a condition on vec_id; share: the budget, fitted if not given."""
    spark = found.sparkSession
    base = written(found, "vectors")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # At most `sample` vectors reach the driver.
    chosen = matrix(pa.array([r["v"] for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()], pa.list_(pa.float64())))
    depth = int(np.clip(np.log2(n / leaf), 0, deepest))
    forest = Forest(chosen, trees, depth)
    share = fitted_share(forest, chosen, k, goal) if share is None else share
    sent = spark.sparkContext.broadcast(forest)  # trees * 2^deepest thresholds and trees * deepest directions at most

    def code(batches):
        forest = sent.value
        for b in batches:
            codes = forest.codes(matrix(b.column(1)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * forest.trees, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows, pa.array(codes[:, 0], pa.int32())], ["vec_id", "v", "codes", "home"])

    coded = written(base.mapInArrow(code, "vec_id long, v array<double>, codes array<int>, home int"), "coded")
    # Members of each leaf of each tree among those of each leaf of the first tree: counted before the shuffle.
    cells = written(coded.select("home", F.posexplode("codes").alias("tree", "leaf")).groupBy("home", "tree", "leaf").count(), "cells")
    sizes = np.zeros((trees, forest.leaves), np.int64)
    for r in cells.groupBy("tree", "leaf").agg(F.sum("count").alias("n")).collect():  # trees * 2^deepest rows at most
        sizes[r["tree"], r["leaf"]] = r["n"]
    budget = max(share * n, trees * (k + 1))

    def members(t: pa.Table) -> pa.Table:
        """The leaves of all trees that one leaf of the first tree shares members with, as a bitmap."""
        mask = np.zeros((trees, sizes.shape[1]), bool)
        mask[t.column("tree").to_numpy(), t.column("leaf").to_numpy()] = True
        return pa.table({"home": t.column("home")[:1], "members": pa.array([bits(mask)], pa.binary())})

    has = {r["home"]: r["members"] for r in cells.groupBy("home").applyInArrow(members, "home int, members binary").collect()}  # 2^deepest bitmaps at most
    homes = sorted(has)
    first, cuts, pieces = packed({h: int(sizes[0, h]) for h in homes}, piece)
    asks = {r["home"]: r["count"] for r in coded.where(is_query).groupBy("home").count().collect()}
    part_first, part_cuts, _ = packed(asks, query_block)
    plan = spark.sparkContext.broadcast((first, cuts, part_first, part_cuts))
    reach = spark.sparkContext.broadcast((sizes, np.frombuffer(b"".join(has[h] for h in homes), np.uint8).reshape(len(homes), -1), [np.arange(first[h], first[h] + cuts[h]) for h in homes]))

    def dealt(which: str):
        """home -> its piece (or its queries' part), by a hash of the id for leaves that are cut."""

        def run(batches):
            starts, times = plan.value[:2] if which == "piece" else plan.value[2:]
            for b in batches:
                number = [starts[h] + x % times[h] for h, x in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(number, pa.int32())], ["vec_id", "v", "codes", which])

        return run

    rows = coded.select("vec_id", "v", "codes", "home", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h"))
    placed = rows.mapInArrow(dealt("piece"), "vec_id long, v array<double>, codes array<int>, piece int")
    queries = rows.where(is_query).mapInArrow(dealt("part"), "vec_id long, v array<double>, codes array<int>, part int")

    def ask(batches):
        """Sends every query, with its leaves, to the pieces that have members of them."""
        forest, (sizes, has, pieces) = sent.value, reach.value
        for b in batches:
            at, to, leaves = [], [], []
            for i, p in enumerate(forest.project(matrix(b.column(1)))):
                mask = bits(forest.mask(p, sizes, budget))
                own = np.flatnonzero((has & np.frombuffer(mask, np.uint8)).any(1))
                goes = np.unique(np.concatenate([pieces[j] for j in own])).tolist() if len(own) else []
                at += [i] * len(goes)
                to += goes
                leaves += [mask] * len(goes)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(3).take(where), pa.array(to, pa.int32()), b.column(0).take(where), b.column(1).take(where), pa.array(leaves, pa.binary())], ["part", "piece", "vec_id", "v", "leaves"])

    def score(_, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k nearest among one piece's candidates for each query of a part."""
        out = [[], [], []]
        ids, x = left.column("vec_id").to_numpy(), matrix(left.column("v").combine_chunks())
        codes = np.asarray(left.column("codes").combine_chunks().flatten()).reshape(-1, trees)
        asks, q = right.column("vec_id").to_numpy(), matrix(right.column("v").combine_chunks())
        wide = max(x.shape[1], q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, q))
        for i, leaves in enumerate(right.column("leaves").to_pylist() if len(ids) else []):
            mask = np.unpackbits(np.frombuffer(leaves, np.uint8))[: trees << depth].reshape(trees, -1).astype(bool)
            there = mask[0][codes[:, 0]]
            for tree in range(1, trees):
                there |= mask[tree][codes[:, tree]]
            some = np.flatnonzero(there)
            places, d = nearest(q[i], int(asks[i]), x[some], ids[some], k)
            out[0] += [int(asks[i])] * len(places)
            out[1] += ids[some[places]].tolist()
            out[2] += d.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    asked = written(queries.mapInArrow(ask, "part int, piece int, vec_id long, v array<double>, leaves binary"), "asked")
    pairs = asked.select(F.col("part").alias("for"), F.col("piece").alias("to")).distinct()
    left = placed.join(pairs, F.col("piece") == F.col("to")).groupBy("for", "to")
    got = left.cogroup(asked.groupBy("part", "piece")).applyInArrow(score, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
