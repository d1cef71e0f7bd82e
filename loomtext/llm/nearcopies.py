"""Near copies by Jaccard similarity of word shingles: SimHash search, completed by MinHash bands, each candidate verified.

1. A node is a distinct text, by 96 bits of its digest. Its set is the XXH64 hashes of its `shingle`-word
   shingles, with words as in simhash: ASCII lower case, cut at white space.
2. simhash.links finds the fingerprints of these shingles that differ in few bits,
   by its partitions and thresholds.
3. Texts of similarity 0.8 have fingerprints that differ in 9.7 bits of 64 on
   average, up to 17 in 99 of 100 cases; no partition of 64 bits searches so far
   with few candidates. So there are BANDS keys of ROWS minima each beside them: two
   sets of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS: 99.995 %
   at 0.8, more above. Keys of several nodes are compared; keys of the same nodes
   are one. A large key is compared in square blocks of about `block` by
   `block` nodes, fewer where their sets are large (about `block_bytes` for each side;
   one set is never cut), and a block returns a spanning forest of its verified links.
4. Connected components of all links, of which each has the similarity asked for.

Defined cases: null and word-less texts have one set and are copies of each
other; fewer words than a shingle give one shingle of all words; columns of any
name and type, maps included, are handed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import simhash
from loomtext.llm.base import fresh, join_with_hot, written
from loomtext.llm.graph import components
from loomtext.llm.simhash import _LOWER, SEED

BANDS, ROWS = 25, 5
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a whole text's shingles, repeats included; never empty."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(data, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Unsigned keys, one for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    data, width = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(data[k * width : (k + 1) * width], k) for k in range(BANDS)]


def node_of(text: Column) -> Column:
    """96 bits: over 1e10 texts, two of them share a node with a probability of 1e-9."""
    return F.substring(F.base64(F.unhex(F.md5(F.coalesce(text, F.lit(""))))), 1, 16)


def forest(nodes: list[str], sets: list[np.ndarray], percent: int) -> list[tuple[str, str]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of at least `percent` / 100."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, left, out = np.zeros(len(names), bool), np.ones(len(nodes), bool), []
    while left.any():
        front = [int(np.argmax(left))]
        left[front[0]] = False
        while front and left.any():
            x = front.pop()
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
            mark[own] = False
            near = np.flatnonzero(left & (both * 100 >= percent * (sizes + sizes[x] - both)))
            left[near] = False
            front += near.tolist()
            out += [(nodes[x], nodes[y]) for y in near]
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def fingerprint_pairs(sketches: DataFrame, distance: int, hot: int) -> DataFrame:
    """(x, y): nodes whose fingerprints are equal or linked by simhash."""
    heads = written(sketches.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    found = simhash.links(heads.select("fp"), distance)
    across = found.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    within = join_with_hot(sketches.select("fp", "node"), heads, "fp", "n", hot).where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    return written(across.unionByName(within), "pairs")


def links(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = 512, distance: int = 3, hot: int = 10_000, block_bytes: int = 8 << 20) -> DataFrame:
    """(a, b): verified links of nodes that connect what all such links among the candidates connect."""

    def sketch(batches):
        for b in batches:
            fps, keys, sizes = [], [], []
            for text in b.column(1).to_pylist():
                h = shingles(text, shingle)
                fps.append(simhash.of_hashes(h) if (text or "").strip(simhash.BLANKS) else 0)
                own = np.unique(h)
                sizes.append(own.nbytes)
                keys.append(np.array(band_keys(own), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["node", "fp", "keys", "size"])

    # Rows of one text are combined before each shuffle, so that a group of copies is no hot key.
    texts = docs.select(node_of(docs["text"]).alias("node"), docs["text"].alias("text"))
    sketched = texts.mapInArrow(sketch, "node string, fp long, keys array<long>, size long")
    sketches = written(sketched.groupBy("node").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("size").alias("size")), "sketches")
    bands = sketches.select("node", "size", F.explode("keys").alias("key"))
    same = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("size").alias("bytes")).where("n > 1")
    pieces = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes))).cast("int")
    cuts = written(same.groupBy("n", "who", "bytes").agg(F.min("key").alias("key")).select("key", "n", pieces.alias("cuts")), "cuts")
    ends = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda other: F.struct(F.least(F.col("c"), other).alias("p"), F.greatest(F.col("c"), other).alias("q")),
    )
    squares = (
        join_with_hot(bands.select("node", "key"), cuts, "key", "n", hot)
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .select("key", "node", F.explode(ends).alias("s"))
        .select("key", "s.p", "s.q", "node")
    )
    squares = written(squares, "squares")

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, shingle)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "hashes"])

    pairs = fingerprint_pairs(sketches, distance, hot)
    met = squares.select("node").unionByName(pairs.select(F.col("x").alias("node"))).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    once = texts.groupBy("node").agg(F.min("text").alias("text"))
    sets = written(once.join(met, "node", "left_semi").mapInArrow(hashed, "node string, hashes binary"), "sets")

    def compare(batches):
        """The rows come sorted, so that a group is a run of rows; it may go over batches."""
        group, nodes, own, out = None, [], [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.string()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for *g, node, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    out += forest(nodes, own, percent) if len(nodes) > 1 else []
                    group, nodes, own = g, [], []
                nodes.append(node)
                own.append(np.frombuffer(data, np.uint64))
            yield batch()
            out = []
        out += forest(nodes, own, percent) if len(nodes) > 1 else []
        yield batch()

    def verify(batches):
        for b in batches:
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    by = ("key", "p", "q")
    whole = squares.join(sets, "node").select(*by, "node", "hashes")
    by_bands = whole.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a string, b string")
    # A text that heads very many others (one fingerprint, or a hub of links) meets them by broadcast.
    heads = sets.select(F.col("node").alias("x"), F.col("hashes").alias("p")).join(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x")
    both = join_with_hot(pairs.join(sets.select(F.col("node").alias("y"), F.col("hashes").alias("q")), "y"), heads, "x", "n", hot)
    return by_bands.unionByName(both.select("x", "y", "p", "q").mapInArrow(verify, "a string, b string"))


def hashable(docs: DataFrame, name: str) -> Column:
    """The column, or its JSON where its type holds a map, which has no hash."""
    return F.to_json(F.struct(docs[name])) if "map<" in docs.schema[name].dataType.simpleString() else docs[name]


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """The rows of docs (with doc_id and text), one of each component of near copies: the first by doc_id (nulls last), hash of the text, hash of the row."""
    found = components(links(docs, shingle, percent, block), "nearcopies")
    node, row = fresh(docs.columns, "node", "row")
    rows = docs.withColumn(node, node_of(docs["text"])).withColumn(row, F.xxhash64(*(F.struct(F.isnull(docs[c]), hashable(docs, c)) for c in docs.columns)))
    rank = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col(node).alias("n"), F.col(row).alias("r"))
    # Minima of each text are combined before the shuffle, so that copies are no hot key.
    firsts = rows.groupBy(F.col(node).alias("own")).agg(F.min(rank).alias("first"))
    named = firsts.join(found, firsts["own"] == found["node"], "left").select(F.coalesce("component", "own").alias("component"), "first")
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.n").alias(node), F.col("first.r").alias(row))
    # Only rows that are equal in all columns share a key here.
    return rows.join(kept, [node, row], "left_semi").dropDuplicates([node, row]).select(*docs.columns)
