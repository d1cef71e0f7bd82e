"""Exact top-k search by inner product over a pivot-distance index.

Index: a vector's key is its nearest pivot and its distance to it; there are
about as many pivots as the square root of the number of vectors. Each pivot's
vectors, in order of distance, form annuli. The summary of all annuli (pivot,
distance ranges to the own pivot and to `REFERENCES` further ones, largest norm,
number of vectors) has at most pivots * rings rows. Annuli are packed into
blocks of about `block` vectors, large ones cut into several.

Search, for a query q and an annulus with distances to pivot p in [lo, hi]: by
the triangle inequality no member is nearer to q than gap = max(0, lo - d(q,p),
d(q,p) - hi), for each of the annulus's pivots, so that with the largest gap
and the largest norm m its inner product is at most (|q|^2 + m^2 - gap^2) / 2,
and at most |q| m. A query first scans the annuli around its own distance,
outwards from its nearest pivots, until they hold `seeds` vectors; its k-th score
is a floor. It then expands to every annulus whose bound reaches the floor (those
of its best seeds are among them), and stops at those whose bound doesn't. A
query travels once to each block that holds such annuli, with a list of these,
and scans none but these there: bounds are worked out where the query is sent
off, in slices of `CELLS` (query, annulus) pairs, and not again in the blocks.

Scores are integers: components are floor(scale * x). Vectors that are null or
hold null or non-finite components take no part. Shorter vectors count as
padded with zeros. Rows that repeat a vec_id are one vector (the smallest).
Ties go to the smaller vec_id. With fewer than k other vectors all are
returned; an empty table gives an empty result. Only vec_id and embedding are
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.llm.base import written


def integer_vectors(df: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): v is floor(scale * x) of every component, one row for each vec_id with a valid vector."""
    x = df[embedding].cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(x.isNotNull() & good & df[vec_id].isNotNull())
    rows = rows.select(rows[vec_id].cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of number arrays as rows of doubles, padded with zeros to the longest (or to `width`)."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = np.asarray(column.flatten(), float)
    out = np.zeros((len(lengths), max(width or 0, int(lengths.max(initial=0)))))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1])))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = same_width(x, pivots)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles hold them while they stay under 2^53."""
    q, x = same_width(q, x)
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**53:
        return np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q], object).reshape(len(q), len(x))
    return (q @ x.T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


#: Bounds are worked out for at most so many pairs of query and annulus at a time: about 64 bytes each.
CELLS = 1 << 21

#: Pivots besides the own one to which an annulus's distances are known.
REFERENCES = 8


class Summary:
    """The annuli as arrays, for the bounds, and the blocks that hold them."""

    def __init__(self, rows, pivots: np.ndarray, block: int = 1 << 14) -> None:
        self.pivots = pivots
        self.pivot, ring = (np.array([r[c] for r in rows], int) for c in ("pivot", "ring"))
        # Rows come in order of pivot and ring, so that their keys ascend.
        self.rings = int(ring.max(initial=0)) + 1
        self.key = self.pivot * self.rings + ring
        self.lo, self.hi, self.norm = (np.array([r[n] for r in rows], float) for n in ("lo", "hi", "norm"))
        self.n = np.array([r["n"] for r in rows], int)
        # Ranges to the first pivots: columns lo0, hi0, ...
        self.references = [j for j in range(min(REFERENCES, len(pivots))) if rows and f"lo{j}" in rows[0]]
        self.far = [(np.array([r[f"lo{j}"] for r in rows], float), np.array([r[f"hi{j}"] for r in rows], float)) for j in self.references]
        # Small annuli share a block, large ones have several.
        self.first, self.cuts = np.zeros(len(rows), int), np.ones(len(rows), int)
        number, held = 0, 0
        for i, n in enumerate(self.n.tolist()):
            if held and held + n > block:
                number, held = number + 1, 0
            self.first[i], held = number, held + n
            if n > block:
                self.cuts[i] = -(-n // block)
                number, held = number + int(self.cuts[i]), 0
        self.blocks = number + (held > 0)

    def annuli_of(self, pivot: np.ndarray, ring: np.ndarray) -> np.ndarray:
        """The numbers of annuli by their pivots and rings."""
        return np.searchsorted(self.key, pivot.astype(int) * self.rings + ring)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gap and upper bound of the score of each query (row) and annulus (column); a margin covers rounding."""
        to_all = distances(q, self.pivots)
        d = to_all[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.lo - d, d - self.hi))
        widest = gap.copy()
        for j, (lo, hi) in zip(self.references, self.far, strict=True):
            d = to_all[:, [j]]
            np.maximum(widest, lo - d, out=widest)
            np.maximum(widest, d - hi, out=widest)
        square, norm = (q * q).sum(1)[:, None], np.sqrt((q * q).sum(1))[:, None]
        widest *= widest
        bound = np.subtract(square + self.norm**2, widest, out=widest)
        bound /= 2
        np.minimum(bound, norm * self.norm, out=bound)
        bound += 1e-6 * (1 + square + self.norm**2)
        return gap, bound

    def wanted(self, q: np.ndarray, floor: np.ndarray | None, enough: int) -> np.ndarray:
        """Which annuli each query scans: at first those in order of gap that hold `enough` vectors, then (with floors) those whose bound reaches the floor."""
        gap, bound = self.bounds(q)
        if floor is not None:
            return bound >= floor[:, None]
        order = np.argsort(gap, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(gap.shape, bool)
        np.put_along_axis(first, order, before < enough, axis=1)
        return first

    def asked(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries and blocks, a pair for each block that holds an annulus the query wants; where each pair's annuli begin and end in the last array."""
        q, a = np.nonzero(wanted)
        times = self.cuts[a]
        q, block = np.repeat(q, times), np.repeat(self.first[a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        # Blocks ascend with the annuli, so that equal pairs stand together.
        starts = np.flatnonzero(np.diff(q, prepend=-1) | np.diff(block, prepend=-1))
        return q[starts], block[starts], np.append(starts, len(q)), np.repeat(a, times)

    def asked_blocks(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) for each block that holds an annulus the query wants."""
        return self.asked(wanted)[:2]

    def slices(self, queries: int):
        """Slices of so many queries, each with at most `CELLS` bounds (one query at least)."""
        step = max(1, CELLS // max(len(self.n), 1))
        return (slice(at, at + step) for at in range(0, queries, step))


def best_of_block(ids: np.ndarray, x: np.ndarray, annulus: np.ndarray, asks: np.ndarray, q: np.ndarray, lists: pa.ListArray, k: int, step: int = 512):
    """(query, vec_id, score): the k best for each query among a block's vectors in the annuli of its list, itself left out."""
    order = np.argsort(annulus, kind="stable")
    own, starts = np.unique(annulus[order], return_index=True)
    members = dict(zip(own.tolist(), np.split(order, starts[1:]), strict=True)) if len(ids) else {}
    ends = np.asarray(lists.offsets)
    for at in range(0, len(asks), step):
        until = min(at + step, len(asks))
        wants = np.asarray(lists.values)[ends[at] : ends[until]]
        who = np.repeat(np.arange(at, until), np.diff(ends[at : until + 1]))
        by_annulus = np.argsort(wants, kind="stable")
        found: dict[int, list] = {}
        names, firsts = np.unique(wants[by_annulus], return_index=True)
        for a, asking in zip(names.tolist(), np.split(who[by_annulus], firsts[1:]), strict=False):
            rows = members.get(a)
            if rows is not None:
                for i, scores in zip(asking.tolist(), products(q[asking], x[rows]), strict=True):
                    keep = best(scores, ids[rows], k + 1)  # one of them may be the query itself
                    found.setdefault(i, []).append((scores[keep], ids[rows][keep]))
        for i, tops in found.items():
            scores, vecs = np.concatenate([t[0] for t in tops]), np.concatenate([t[1] for t in tops])
            other = np.flatnonzero(vecs != asks[i])
            for j in other[best(scores[other], vecs[other], k)]:
                yield int(asks[i]), int(vecs[j]), int(scores[j])


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, most_rings: int = 64, block: int = 1 << 14, query_block: int = 8192, seeds: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, v); `is_query` is a condition on vec_id; pivots: the square root of the vectors, from 16 to 4096, if not given."""
    base = written(vectors, "vectors")
    n = base.count()
    pivots = pivots or int(min(max(n**0.5, 16), 4096))
    # Pivots: the vectors with the smallest hashes. At most `pivots` rows reach the driver.
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    centers = matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.int64()))) if chosen else np.zeros((1, 1))
    near = range(min(REFERENCES, len(centers)))
    sent = base.sparkSession.sparkContext.broadcast(centers)  # at most 4096 vectors

    def key(batches):
        centers = sent.value
        for b in batches:
            x = matrix(b.column(1))
            d = distances(x, centers)
            p = d.argmin(1)
            cols = [b.column(0), b.column(1), pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p]), pa.array(np.sqrt((x * x).sum(1))), *(pa.array(d[:, j]) for j in near)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "pivot", "dist", "norm", *(f"d{j}" for j in near)])

    keyed = written(base.mapInArrow(key, "vec_id long, v array<long>, pivot int, dist double, norm double" + "".join(f", d{j} double" for j in near)), "keyed")
    rings = min(most_rings, max(4, -(-4 * n // (block * pivots))))
    reach = keyed.groupBy("pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far")).collect()  # at most `pivots` rows
    low, width = np.zeros(len(centers)), np.ones(len(centers))
    for r in reach:
        low[r["pivot"]], width[r["pivot"]] = r["near"], max(r["far"] - r["near"], 1e-9)
    spans = base.sparkSession.sparkContext.broadcast((low, width))  # two numbers for each pivot

    def ringed(*columns: Column) -> DataFrame:
        """pivot, dist, the columns, and each vector's ring: its place between its pivot's nearest and farthest."""
        own = keyed.select("pivot", "dist", *columns)
        names = [*own.columns, "ring"]

        def run(batches):
            low, width = spans.value
            for b in batches:
                p = np.asarray(b.column(0))
                ring = np.minimum((np.asarray(b.column(1)) - low[p]) / width[p] * rings, rings - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring)], names)

        return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("ring", T.IntegerType())]))

    ranges = [f(f"d{j}").alias(f"{name}{j}") for j in near for name, f in (("lo", F.min), ("hi", F.max))]
    rows = ringed("norm", *(f"d{j}" for j in near)).groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n"), *ranges)
    summary = Summary(rows.orderBy("pivot", "ring").collect(), centers, block)  # at most pivots * rings rows
    index = base.sparkSession.sparkContext.broadcast(summary)
    parts = max(1, -(-keyed.where(is_query).count() // query_block))

    def place(batches):
        """Every vector with its annulus and block."""
        s = index.value
        for b in batches:
            a = s.annuli_of(np.asarray(b.column(0)), np.asarray(b.column(5)))
            spread = np.asarray(b.column(4)) % s.cuts[a]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(a, pa.int32()), pa.array(s.first[a] + spread, pa.int32())], ["vec_id", "v", "annulus", "block"])

    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    placed = ringed(F.col("vec_id"), F.col("v"), hashed.alias("h")).mapInArrow(place, "vec_id long, v array<long>, annulus int, block int")
    queries = keyed.where(is_query).select("vec_id", "v").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).cast("int"))

    def ask(first: bool, with_vectors: bool):
        """Sends every query to the blocks that hold what it wants: at first, or (with its floor) after that."""
        names = ["part", "block"] + ["vec_id", "v", "annuli"] * with_vectors

        def run(batches):
            s = index.value
            for b in batches:
                for rows in s.slices(b.num_rows):
                    part = b.slice(rows.start, rows.stop - rows.start)
                    floor = np.nan_to_num(np.asarray(part.column(3).to_numpy(zero_copy_only=False), float), nan=-np.inf)
                    q, to, ends, annuli = s.asked(s.wanted(matrix(part.column(1)), None if first else floor, seeds))
                    at = pa.array(q, pa.int64())
                    cols = [part.column(2).take(at), pa.array(to, pa.int32())]
                    if with_vectors:
                        cols += [part.column(0).take(at), part.column(1).take(at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(annuli, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, names)

        return run

    def score(_, left, right):
        """The k best of one block for each query that asks for it, among the annuli it wants."""
        ids, x = left.column("vec_id").to_numpy(), matrix(left.column("v").combine_chunks())
        lists, q = right.column("annuli").combine_chunks(), matrix(right.column("v").combine_chunks())
        found = list(best_of_block(ids, x, left.column("annulus").to_numpy(), right.column("vec_id").to_numpy(), q, lists, k))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    def scan(asking: DataFrame, first: bool) -> DataFrame:
        pairs = asking.mapInArrow(ask(first, False), "part int, block int").distinct()
        blocks = placed.join(pairs, "block").groupBy("part", "block")
        asked = asking.mapInArrow(ask(first, True), "part int, block int, vec_id long, v array<long>, annuli array<int>").groupBy("part", "block")
        return blocks.cogroup(asked).applyInArrow(score, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    seeded = ranked(scan(queries.withColumn("floor", F.lit(None).cast("double")), True))
    floors = seeded.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    found = scan(written(queries.join(floors, "vec_id", "left").select("vec_id", "v", "part", "floor"), "floors"), False)
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def scanned_share(queries: np.ndarray, floor: np.ndarray, summary: Summary, seeds: int = 256) -> float:
    """The share of all (query, vector) pairs that these queries, given their k-th scores, scan."""
    seen = (summary.wanted(queries, None, seeds) | summary.wanted(queries, floor, seeds)) @ summary.n
    return float(seen.mean() / max(summary.n.sum(), 1))
