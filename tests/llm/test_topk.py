import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>, vec_pivot int, pivot string, v string"


def brute(rows, k=5, every=50):
    vecs: dict = {}
    for r in rows:
        if r[0] is None or r[1] is None or any(x is None or not math.isfinite(x) for x in r[1]):
            continue
        v = [math.floor(256 * x) for x in r[1]]
        vecs[r[0]] = min(vecs.get(r[0], v), v)
    out = set()
    for q, v in vecs.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vecs.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def run(spark, rows, **options):
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    return {tuple(r) for r in T.search(T.integer_vectors(d), F.col("vec_id") % 50 == 0, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "block": 16, "query_block": 3}, {"pivots": 3, "block": 100}])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16))
    x = centers[rng.integers(0, 6, 900)] + rng.normal(size=(900, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # ties with each other
    assert run(spark, rows, **options) == brute(rows)


def test_awkward_vectors(spark):
    good = [(k, [random.Random(k).uniform(-1, 1) for _ in range(4)]) for k in range(120)]
    bad = [(200, None), (250, [1.0, None]), (300, [float("nan"), 1.0]), (350, [float("inf")]), (None, [1.0])]
    rows = [*good, *bad, good[50], (50, [0.5, 0.5, 0.5, 0.5]), (400, [0.25]), (450, []), (500, [1e9, -1e9, 3e8, 1e9])]
    assert run(spark, rows) == brute(rows)


def test_few_or_none(spark):
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, [(0, [1.0]), (1, [1.0]), (2, [1.0])]) == {(0, 1, 1, 65536), (0, 2, 2, 65536)}


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, pivots, q = (rng.integers(-200, 200, (n, 8)).astype(float) for n in (300, 4, 40))
    d = T.distances(x, pivots)
    p = d.argmin(1)
    rows = []
    for k in range(4):
        own = np.flatnonzero(p == k)
        for ring in np.array_split(own[np.argsort(d[own, k])], 3):
            if len(ring):
                rows.append({"pivot": k, "ring": len(rows), "lo": d[ring, k].min(), "hi": d[ring, k].max(), "norm": np.linalg.norm(x[ring], axis=1).max(), "n": len(ring), "cuts": 1, "own": ring})
    _, bound = T.Summary(rows, pivots).bounds(q)
    for a, r in enumerate(rows):
        assert ((q @ x[r["own"]].T).max(1) <= bound[:, a]).all()


def test_references_sharpen_bounds_and_blocks_hold_all():
    """Ranges to further pivots: bounds stay true and get smaller; every annulus has its blocks."""
    rng = np.random.default_rng(8)
    x = rng.integers(-200, 200, (500, 6)).astype(float)
    pivots, q = x[:10], x[490:]
    d = T.distances(x, pivots)
    p, rows = d.argmin(1), []
    for k in range(10):
        own = np.flatnonzero(p == k)
        for n, ring in enumerate(np.array_split(own[np.argsort(d[own, k])], 3)):
            if len(ring):
                refs = {f"{name}{j}": f(d[ring, j]) for j in range(T.REFERENCES) for name, f in (("lo", np.min), ("hi", np.max))}
                rows.append({"pivot": k, "ring": n, "lo": d[ring, k].min(), "hi": d[ring, k].max(), "norm": np.linalg.norm(x[ring], axis=1).max(), "n": len(ring), "own": ring, **refs})
    with_refs = T.Summary(rows, pivots, 40)
    without = T.Summary([{k: v for k, v in r.items() if k[:2] not in ("lo", "hi") or k in ("lo", "hi")} for r in rows], pivots, 40)
    sharp, blunt = with_refs.bounds(q)[1], without.bounds(q)[1]
    assert (sharp <= blunt).all() and (sharp < blunt - 1).any()
    for a, r in enumerate(rows):
        assert ((q @ x[r["own"]].T).max(1) <= sharp[:, a]).all()
    floor = np.sort(q @ x.T, axis=1)[:, -5]
    assert T.scanned_share(q, floor, with_refs, 20) <= T.scanned_share(q, floor, without, 20) <= 1
    wanted = with_refs.wanted(q, floor, 20) | with_refs.wanted(q, None, 20)
    for i, scores in enumerate(q @ x.T):  # nothing that reaches the floor is left out
        need = {a for a, r in enumerate(rows) if (scores[r["own"]] >= floor[i]).any()}
        assert need <= set(np.flatnonzero(wanted[i]).tolist())
    held = [(a, b) for a in range(len(rows)) for b in range(with_refs.first[a], with_refs.first[a] + with_refs.cuts[a])]
    assert {b for _, b in held} == set(range(with_refs.blocks))
    who, block = with_refs.asked_blocks(wanted)
    assert {(i, b) for i in range(len(q)) for a, b in held if wanted[i, a]} == set(zip(who.tolist(), block.tolist(), strict=True))


def test_annuli_in_several_blocks_and_seeds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 8)))]
    for options in ({"pivots": 2, "block": 30, "query_block": 4, "seeds": 10}, {"pivots": 40, "block": 64, "seeds": 1}, {"block": 10_000, "seeds": 10_000}):
        assert run(spark, rows, **options) == brute(rows)


def test_many_annuli_in_bounded_memory():
    """4,096 pivots with 60 rings each: queries are sent off in slices, and a block needs no bounds."""
    import time
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    pivots = rng.integers(-256, 256, (4096, 64)).astype(float)
    lo = np.sort(rng.uniform(500, 1500, (4096, 60)), axis=1)
    rows = [{"pivot": p, "ring": r, "lo": lo[p, r], "hi": lo[p, r] + 20.0, "norm": 1200.0, "n": 4000} for p in range(4096) for r in range(60)]
    s = T.Summary(rows, pivots)
    assert s.annuli_of(np.array([0, 17, 4095]), np.array([0, 5, 59])).tolist() == [0, 17 * 60 + 5, 4096 * 60 - 1]
    q = rng.integers(-256, 256, (1000, 64)).astype(float)
    slices = list(s.slices(1000))
    assert sum(len(q[i]) for i in slices) == 1000 and all(len(q[i]) * len(rows) <= T.CELLS for i in slices)
    tracemalloc.start()
    for i in slices[:3]:
        s.asked(s.wanted(q[i], None, 256))
        s.asked(s.wanted(q[i], np.full(len(q[i]), 2e5), 256))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    # A block of 16,000 vectors in 4 annuli, asked for by 1,000 queries.
    x = rng.integers(-256, 256, (16_000, 64)).astype(float)
    lists = pa.array([[7, 8, 9, 10]] * 1000, pa.list_(pa.int32()))
    began = time.process_time()
    found = list(T.best_of_block(np.arange(16_000), x, np.repeat([7, 8, 9, 10], 4000), np.arange(1000), q, lists, 5))
    spent = time.process_time() - began
    scores = (q @ x.T).astype(np.int64)
    assert len(found) == 5000 and spent < 60
    for i in (0, 1, 999):
        want = sorted(((-v, j) for j, v in enumerate(scores[i].tolist()) if j != i))[:5]
        assert [f[1:] for f in found if f[0] == i] == [(j, -v) for v, j in want]
