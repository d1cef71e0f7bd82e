import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import forest


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)


def brute(x, step, k):
    out = {}
    for q in range(0, len(x), step):
        d = [(float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in range(len(x)) if i != q]
        out[q] = sorted(d)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, true):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in t}) / len(t) for q, t in true.items()])


def test_recall_on_far_vectors(spark):
    x = np.random.default_rng(2).standard_normal((3000, 32))
    got = found(forest.search(forest.vectors(table(spark, x)), F.col("vec_id") % 50 == 0, leaf=40, piece=500, query_block=20))
    true = brute(x, 50, 10)
    assert recall(got, true) >= 0.9
    for q, rows in got.items():  # exact distances, in order, ties to the smaller id
        assert rows == sorted(rows) and len(rows) == 10
        assert np.allclose([s for s, _ in rows], [np.linalg.norm(x[q] - x[i]) for _, i in rows], rtol=1e-14)


def test_clusters_take_a_small_share():
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((60, 32)) * 6
    x = np.repeat(centers, 100, 0) + rng.standard_normal((6000, 32))
    f = forest.Forest(x, 16, 6)
    assert forest.fitted_share(f, x, 10, 0.95, 60) < 0.5
    far = rng.standard_normal((6000, 32))
    assert forest.fitted_share(forest.Forest(far, 16, 6), far, 10, 0.95, 60) > 0.3


def test_shared_queue_takes_leaves_by_the_planes_crossed():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 8))
    f = forest.Forest(x, 3, 4)
    sizes = f.sizes(f.codes(x))
    assert sizes.sum(1).tolist() == [500] * 3
    p = f.project(x[:1])[0]
    far = {}
    for t in range(3):
        for leaf in range(16):
            crossed, node = 0.0, 0
            for level in range(4):
                margin, side = p[t * 4 + level] - f.thresholds[t][level][node], leaf >> (3 - level) & 1
                crossed = max(crossed, abs(margin) if side != (margin > 0) else 0.0)
                node = 2 * node + side
            far[t, leaf] = crossed
    order = list(f.taken(p, sizes, np.inf))
    assert len(order) == len(set(order)) == 48
    assert [far[x] for x in order] == sorted(far.values())


def test_whole_budget_is_exact(spark):
    x = np.random.default_rng(7).integers(-2, 3, (400, 3)).astype(float)
    x = x[np.abs(x).sum(1) > 0]
    got = found(forest.search(forest.vectors(table(spark, x)), F.col("vec_id") % 10 == 0, leaf=10, piece=64, query_block=8, share=4.0))
    assert got == brute(x, 10, 10)


def test_copies_and_hot_vector(spark):
    """A third of the rows are one vector: its leaf is cut into pieces, nothing is lost."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.ones((300, 6)), rng.standard_normal((600, 6))])
    got = found(forest.search(forest.vectors(table(spark, x)), F.col("vec_id") % 20 == 0, leaf=20, piece=50))
    true = brute(x, 20, 10)
    assert all(got[q] == true[q] for q in range(0, 300, 20))
    assert recall(got, true) >= 0.9


def test_awkward(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (0, [1.0, 0.0]), (0, [0.5, 9.0]), (7, [1.0]), (8, [1.0, 0.0, 2.0]), (9, [3.0, 4.0]), (9, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, codes int")
    got = found(forest.search(forest.vectors(df), F.lit(True)))
    x = {0: [0.5, 9, 0], 7: [1, 0, 0], 8: [1, 0, 2], 9: [3, 4, 0]}
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in sorted((np.linalg.norm(np.subtract(x[q], x[i])), i) for i in x if i != q)] for q in x}
    empty = forest.search(forest.vectors(df.where("false")), F.lit(True))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
