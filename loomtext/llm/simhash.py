"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A 64-bit fingerprint of every whole text (XXH64 of its word shingles).
2. Bits that correlate are grouped into partitions of about equal information,
   from the pair counts of all fingerprints' bits. Bits that say little, or
   nothing new, make a partition longer.
3. Dynamic programming gives partition i a threshold t_i >= -1 with
   sum(t_i) = distance - partitions + 1: two fingerprints that differ in at
   most `distance` bits then differ in at most t_i bits of some partition i.
   The cost of (i, t) is the estimated number of candidates: the pairs of
   fingerprints that agree on the whole partition, counted over all of them, and
   for t bits more the growth that the bits' frequencies give. t_i = -1 leaves a
   partition out. The number of partitions is the one of least cost.
4. Fingerprints probe: t_i = 0 by the partition's bits, t_i = t by these with
   each t-subset of bits masked. Those with a common key are compared.
5. Connected components of the links.

A key that many fingerprints have is compared in square blocks of at most
`block` by `block` fingerprints, each a group of its own; a block returns a
spanning forest of its links and not all pairs. Equal fingerprints are one
fingerprint before the search, so that copies are never compared.

Defined cases: null and word-less texts have fingerprint zero and link like
others; fewer words than a shingle give one shingle of all words; rows that
repeat a doc_id stay separate rows; a null doc_id never becomes a component's
name unless all its documents have none; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import join_with_hot, written
from loomtext.llm.graph import components

SEED, BITS = 42, 64
#: A probe row, shuffled and sorted, costs about as much as so many comparisons.
ROW_COST = 200
#: Numbers of partitions to choose from.
PARTS = (2, 3, 4, 5, 6)
BLANKS = " \t\n\r\x0b\x0c"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first; bytes are summed eight at a time."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        spread = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), BITS).view(np.uint64)
        for k in range(0, len(part), 255):
            total += spread[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(data, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return of_hashes(np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    ones = bit_sums(hashes) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.asarray(b.column(0)).astype(np.int64)
            for at in range(0, len(x), 8192):
                bits = np.unpackbits(np.ascontiguousarray(x[at : at + 8192]).view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "c"])

    sums = fps.select("fp").mapInArrow(run, "n long, c array<double>")
    row = sums.select("n", F.posexplode("c").alias("k", "c")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()  # 4096 rows
    counts = np.zeros(BITS * BITS)
    for r in row:
        counts[r["k"]] = r["c"]
    return (row[0]["n"] if row else 0), counts.reshape(BITS, BITS)


def group_bits(n: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """`parts` groups of about equal information: a group starts from the free bit with the most correlation and takes the bits that correlate most with it."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.clip(np.outer(p * (1 - p), p * (1 - p)), 1e-12, None))
    rho = np.minimum(np.abs(cov / dev), 1)
    np.fill_diagonal(rho, 0)
    alone = -np.log2(np.clip(p * p + (1 - p) ** 2, 1e-12, 1)) + 1e-3  # of a bit: how rarely two fingerprints agree on it
    free, groups = set(range(BITS)), []
    for k in range(parts):
        left = sorted(free)
        group = [max(left, key=lambda b: (rho[b, left].sum(), -b))]
        free.remove(group[0])
        goal = sum(alone[b] * (1 - max(rho[b, left]) ** 2) for b in left) / (parts - k)
        held = alone[group[0]] * (1 - rho[group[0], left].max() ** 2) if len(left) > 1 else 0.0
        while len(free) > parts - k - 1:
            best = max(sorted(free), key=lambda b: (rho[b, group].sum(), -b))
            new = alone[best] * (1 - rho[best, left].max() ** 2)
            copy = rho[best, group].max() > 0.9  # belongs here, at no cost
            if k + 1 < parts and not copy and held + new / 2 > goal:
                break
            group.append(best)
            free.remove(best)
            held += new
        groups.append(sorted(group))
    return groups


def agreeing_pairs(fps: DataFrame, masks: list[int]) -> list[float]:
    """For each mask the number of pairs of fingerprints that agree on its bits, over all of them."""
    keys = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    sizes = fps.select(F.explode(keys).alias("k")).groupBy("k.mask", "k.key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = {r["mask"]: r["pairs"] for r in sizes.groupBy("mask").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}  # a row for each mask
    return [found.get(k, 0.0) for k in range(len(masks))]


def candidate_costs(n: int, counts: np.ndarray, groups: list[list[int]], most: int, agree: list[float] | None = None, block: int = 512) -> np.ndarray:
    """cost[i, t + 1]: estimated pairs within t bits in group i, t from -1 to most, and a row for each probe
    and for each copy that meets a block (a key of k fingerprints copies each k / block times).

    agree: pairs that agree on each whole group, as counted; without it, as many
    as if bits were independent. With t it grows as for independent bits.
    """
    n = max(n, 2)  # with no cost at all, any number of probes would do
    p = np.diag(counts) / n
    differ = 2 * p * (1 - p)
    cost = np.zeros((len(groups), most + 2))
    for i, group in enumerate(groups):
        dist = np.array([1.0])
        for b in group:
            dist = np.convolve(dist, [1 - differ[b], differ[b]])
        within = np.cumsum(np.append(dist, np.zeros(most + 1)))[: most + 1]
        pairs = n * n / 2 * within if agree is None else np.minimum(agree[i] * within / max(within[0], 1e-30), n * n / 2)
        subsets = 1.0
        for t in range(most + 1):
            subsets = subsets * (len(group) - t + 1) / t if t else 1.0
            cost[i, t + 1] = pairs[t] * (1 + t) * (1 + 2 * ROW_COST / block) + ROW_COST * n * max(subsets, 1.0)
            if t > len(group):  # no more bits to mask
                cost[i, t + 1] = np.inf
    return cost


def allocate(cost: np.ndarray, distance: int) -> list[int]:
    """The thresholds of least total cost with sum distance - parts + 1, by dynamic programming over parts."""
    parts, width = cost.shape
    need = distance + 1  # of t_i + 1
    best = np.full((parts + 1, need + 1), np.inf)
    took = np.zeros((parts + 1, need + 1), int)
    best[0, 0] = 0
    for i in range(parts):
        for s in range(need + 1):
            for t in range(min(s, width - 1) + 1):
                if (c := best[i, s - t] + cost[i, t]) < best[i + 1, s]:
                    best[i + 1, s], took[i + 1, s] = c, t
    out, s = [], need
    for i in range(parts, 0, -1):
        out.append(int(took[i, s]) - 1)
        s -= took[i, s]
    return out[::-1]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """For each probe the bits that must agree, as a signed long."""
    masks = []
    for group, t in zip(groups, thresholds, strict=True):
        for out in combinations(group, t) if t >= 0 else []:
            masks.append(signed(sum(1 << b for b in group if b not in out)))
    return masks


def forest(nodes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a small array of distinct fingerprints."""
    left = np.ones(len(nodes), bool)
    out = []
    while left.any():
        front = [int(np.argmax(left))]
        left[front[0]] = False
        while front:
            x = front.pop()
            near = np.flatnonzero(left & (np.bitwise_count((nodes ^ nodes[x]).view(np.uint64)) <= distance))
            left[near] = False
            front += near.tolist()
            out += [(int(nodes[x]), int(nodes[y])) for y in near]
    return out


def plan(fps: DataFrame, distance: int, parts: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds of the number of partitions that costs least."""
    n, counts = bit_statistics(fps)
    schemes = [group_bits(n, counts, k) for k in parts]
    agree = agreeing_pairs(fps, [signed(sum(1 << b for b in g)) for groups in schemes for g in groups])
    best, at = None, 0
    for groups in schemes:
        cost = candidate_costs(n, counts, groups, distance, agree[at : at + len(groups)])
        at += len(groups)
        thresholds = allocate(cost, distance)
        total = sum(cost[i, t + 1] for i, t in enumerate(thresholds))
        if best is None or total < best[0]:
            best = (total, groups, thresholds)
    return best[1:]


def links(fps: DataFrame, distance: int = 3, parts: tuple[int, ...] = PARTS, block: int = 512, hot: int = 10_000) -> DataFrame:
    """(a, b): links of distinct fingerprints within `distance` bits that connect what all such links connect."""
    masks = probe_masks(*plan(fps, distance, parts))
    keys = F.array(*(F.struct(F.lit(k).alias("probe"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    probes = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.probe", "k.key")
    # A key of one fingerprint has nothing to compare. Larger ones are cut into pieces of about `block`;
    # a group is a pair of pieces. Keys of very many meet their number of pieces by broadcast.
    cuts = written(probes.groupBy("probe", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / block).cast("int")), "cuts")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda other: F.struct(F.least(F.col("c"), other).alias("p"), F.greatest(F.col("c"), other).alias("q")),
    )
    squares = (
        join_with_hot(probes, cuts, ["probe", "key"], "n", hot)
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        .select("probe", "key", "fp", F.explode(pairs).alias("s"))
        .select("probe", "key", "s.p", "s.q", "fp")
    )

    def compare(batches):
        """The rows come sorted, so that a group is a run of rows; it may go over batches."""
        key, held, out = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for *group, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != key:
                    out += forest(np.array(held, np.int64), distance) if len(held) > 1 else []
                    key, held = group, []
                held.append(fp)
            yield batch()
            out = []
        out += forest(np.array(held, np.int64), distance) if len(held) > 1 else []
        yield batch()

    by = ("probe", "key", "p", "q")
    return squares.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, parts: tuple[int, ...] = PARTS, block: int = 512, hot: int = 10_000) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows = written(with_fingerprints(docs, shingle), "fingerprints")
    # One row for each distinct fingerprint, with the smallest document that has it.
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(links(fps.select("fp"), distance, parts, block, hot), "simhash", hub=hot)
    named = written(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    # A giant component, and a fingerprint of very many copies, are no hot keys: these meet by broadcast.
    by_fp = written(join_with_hot(named, least, "component", "m", hot).select("fp", "component_id", "n"), "by_fp")
    return join_with_hot(rows, by_fp, "fp", "n", hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
