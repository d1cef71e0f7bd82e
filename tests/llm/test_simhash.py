import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import simhash as S
from loomtext.llm.graph import components


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, awkward):
    for r in S.with_fingerprints(awkward).join(awkward.select(F.col("doc_id").alias("d"), "text"), F.col("d").eqNullSafe(F.col("doc_id"))).collect():
        assert r["fp"] % (1 << 64) == brute_fingerprint(r["text"])
    # The session's own hash is the same function.
    h = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h % (1 << 64) == S.fingerprint("a b c")


def test_bit_sums():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64)
    assert S.bit_sums(h).tolist() == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


def clusters(rng, groups, size, flips):
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.add(S.signed(x))
    return sorted(out)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    fps = clusters(rng, 25, 12, 4) + clusters(rng, 1, 120, 2)
    want = brute_components([(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3], fps)
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    for parts, block in (((4,), 512), ((3,), 8), ((2,), 512), ((2, 3, 4), 5)):
        found = S.links(d, 3, parts, block).collect()
        assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3 for r in found)
        assert brute_components([(r["a"], r["b"]) for r in found], fps) == want


def test_whole_operator(spark, awkward):
    rows = S.near_duplicates(awkward).collect()
    own = awkward.collect()
    assert len(rows) == len(own)
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in own}
    ids = sorted(k for k in fp if k is not None)
    comp = brute_components([(a, b) for a, b in itertools.combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    for r in rows:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
        if r["doc_id"] is not None:
            assert r["component_id"] == comp[r["doc_id"]]


def test_allocation_is_least():
    rng = random.Random(3)
    for parts in (2, 3, 4):
        cost = np.array([[0.0, *sorted(rng.random() * 10 for _ in range(4))] for _ in range(parts)])
        t = S.allocate(cost, 3)
        assert sum(t) == 3 - parts + 1
        every = [c for c in itertools.product(range(-1, 4), repeat=parts) if sum(c) == 3 - parts + 1]
        assert abs(sum(cost[i, x + 1] for i, x in enumerate(t)) - min(sum(cost[i, x + 1] for i, x in enumerate(c)) for c in every)) < 1e-12


def test_correlated_bits_share_a_partition():
    counts = np.full((64, 64), 250.0)
    np.fill_diagonal(counts, 500.0)
    for a, b in ((0, 40), (1, 50)):
        counts[a, b] = counts[b, a] = 500.0
    groups = S.group_bits(1000, counts, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(any(a in g and b in g for g in groups) for a, b in ((0, 40), (1, 50)))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}}


def test_empty(spark, nothing):
    assert S.near_duplicates(nothing).count() == 0


def test_skewed_bits_get_unequal_groups_and_thresholds(spark):
    """Half of the bits are nearly constant, or copies of others: groups and thresholds differ, components don't."""
    rng = random.Random(31)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(24)
        base |= (base & 0xFFFF) << 24  # copies of sixteen bits; the highest 24 are rarely set
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(S.signed(x))
    fps = sorted(fps)
    d = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    for parts in ((3,), (5,), S.PARTS):
        groups, thresholds = S.plan(d, 3, parts)
        assert sum(thresholds) == 3 - len(groups) + 1 and sorted(b for g in groups for b in g) == list(range(64))
        assert len({len(g) for g in groups}) > 1
        assert len(parts) > 1 or len(set(thresholds)) == 2
    want = brute_components([(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3], fps)
    for parts in ((3,), (5,), S.PARTS):
        assert brute_components([(r["a"], r["b"]) for r in S.links(d, parts=parts).collect()], fps) == want


def test_agreeing_pairs_are_counted(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(8) for _ in range(60)]
    masks = [0xF, 0xF0, S.signed(1 << 63), 0xFF]
    d = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    assert S.agreeing_pairs(d, masks) == [sum((a & m) == (b & m) for a, b in itertools.combinations(fps, 2)) for m in masks]


def test_hubs_and_giant_components(spark):
    """A hub, a long path between hubs, and a group of many copies, through the broadcast side."""
    edges = [(0, k) for k in range(1000, 1400)] + [(5000, k) for k in range(6000, 6300)] + [(1399, 4000), (4000, 4001), (4001, 6299)] + [(9000, 9001)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), hub=50).collect()}
    assert got == brute_components(edges, sorted({n for e in edges for n in e}))
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefghij") * 3 for _ in range(300))
    texts = [base] * 150 + [base + f" {k}" for k in range(120)] + [f"quite another text number {k} of its own" for k in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    a, b = (sorted(map(tuple, S.near_duplicates(d, hot=h).collect())) for h in (20, 10_000))
    assert a == b and len(a) == len(texts) and sum(r[2] == 0 for r in a) > 200


def test_keys_of_many_meet_their_cuts_by_broadcast(spark):
    rng = random.Random(12)
    fps = clusters(rng, 10, 8, 4) + clusters(rng, 1, 150, 2)
    want = brute_components([(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3], fps)
    d = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    assert brute_components([(r["a"], r["b"]) for r in S.links(d, block=16, hot=3).collect()], fps) == want
