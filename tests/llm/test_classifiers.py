import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import base, langid, quality, toxicity

from .conftest import LEXICON, words

TABLES = "/root/testdata/sf0.01"


def test_word_hashes_are_by_word():
    h = base.WordHasher()
    a = h.hashes("The cat, the CAT; naïve-dog 12 the")
    assert len(a) == 7 and a[0] == a[2] == a[6] and a[1] == a[3] and len(set(a.tolist())) == 4
    assert len(h.hashes(None)) == 0 == len(h.hashes("... 12"))
    # Words across the ends of pieces, one of them longer than two pieces.
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (base.PIECE - 2, 7, 2 * base.PIECE + 9, 3, base.PIECE, 1, 5, base.PIECE - 1, 4)]
    single = [int(h._words(p.encode())[2][0]) if len(p) <= base.PIECE else sum(ord(c) * pow(base._ODD, k, 2**64) for k, c in enumerate(p)) % 2**64 for p in parts]
    mixed = lambda v: (v ^ v >> 29) * 0xBF58476D1CE4E5B9 % 2**64
    assert h.hashes(" ".join(parts)).tolist() == [mixed(v) ^ mixed(v) >> 32 for v in single]
    long = "word " * 500_000
    assert set(h.hashes(long).tolist()) == set(h.hashes("word").tolist())


def test_logistic_has_zero_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(float)
    b = base.fit_logistic(x, y, 0.5)
    p = base.sigmoid(x @ b[:-1] + b[-1])
    assert np.abs(x.T @ (p - y) + 0.5 * b[:-1]).max() < 1e-4
    assert base.sigmoid(base.fit_logistic(x, np.ones(300))[-1:])[0] == pytest.approx(300.5 / 301)


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(1200):
        w, bad = words(rng, rng.randint(5, 120)), k % 5 == 0
        for _ in range(rng.randint(2, 8) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(LEXICON))
        rows.append((k, " ".join(w), bad))
        if k % 2 == 0:
            labels += [(k, int(bad))] * (1 + (k % 10 == 0))
    return spark.createDataFrame(rows, "doc_id long, text string, bad boolean"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_chain_on_unseen_documents(spark, toxic_corpus):
    docs, labels = toxic_corpus
    got = toxicity.toxicity(docs, labels).where("doc_id % 2 = 1").groupBy("bad", "rejected").count().collect()
    n = {(r["bad"], r["rejected"]): r["count"] for r in got}
    assert n.get((True, False), 0) <= 1 and n.get((False, True), 0) <= 2 and n[(True, True)] > 100
    p = toxicity.toxicity(docs, labels).agg(*(F.max(c) for c in ("p_toxic", "p_severe", "p_varied"))).first()
    assert all(0.5 < v <= 1 for v in p)


def test_chain_against_plain_python():
    """Each model sees the features and the held-out probabilities of those before it, row by row."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (150, 4)).astype(float)
    y = np.column_stack([x[:, 0] > 2, (x[:, 0] > 2) & (x[:, 1] > 1), rng.random(150) > 0.5]).astype(float)
    fold = np.arange(150) * 7 % 5
    c = toxicity.Chain(x, y, ["a", "b", "c"], fold=fold)
    chance = lambda beta, row: 1 / (1 + np.exp(-(sum(b * v for b, v in zip(beta, row, strict=False)) + beta[-1])))
    rows = [list(r) for r in x]
    for j in range(3):
        whole = base.fit_logistic(np.array(rows), y[:, j], 0.1)
        assert np.allclose(whole, c.models[j])
        held = [0.0] * 150
        for f in range(5):
            rest = [i for i in range(150) if fold[i] != f]
            beta = base.fit_logistic(np.array([rows[i] for i in rest]), y[rest, j], 0.1)
            for i in set(range(150)) - set(rest):
                held[i] = chance(beta, rows[i])
        rows = [[*r, h] for r, h in zip(rows, held, strict=True)]
    assert np.allclose([r[4:] for r in rows], c.out_of_fold)
    got = c.predict(x)
    for i in range(0, 150, 7):
        row = list(x[i])
        for beta in c.models:
            row.append(chance(beta, row))
        assert np.allclose(row[4:], got[i])


def test_categories_of_the_label_table(spark):
    """Own category columns: each document's probabilities follow them, and any of them rejects it."""
    rng = random.Random(13)
    bad = {"insult": ["idiot", "moron"], "threat": ["stab", "burn"], "obscene": ["filth", "smut"]}
    rows, labels = [], []
    for k in range(900):
        own = [c for i, c in enumerate(bad) if k % 7 == i or k % 11 == i]
        w = words(rng, rng.randint(20, 60))
        for c in own:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad[c]))
        rows.append((k, " ".join(w), "in", True, 0.5))
        if k % 2:
            labels.append((k, *(int(c in own) for c in bad)))
    labels += [(1, 0, 0, 0), (3, None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_insult string, rejected boolean, p_other double")
    table = spark.createDataFrame(labels, "doc_id long, insult int, threat int, obscene int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, table, list(bad)).collect()}
    assert len(got) == 900 and got[0]["p_other"] == 0.5
    wrong = 0
    for k in range(0, 900, 2):
        truth = [k % 7 == i or k % 11 == i for i in range(3)]
        said = [got[k][f"p_{c}"] > 0.5 for c in bad]
        assert got[k]["rejected"] == any(said)
        wrong += said != truth
    assert wrong <= 9


def test_derived_categories_come_from_the_other_folds():
    count = np.array([[3, 0, 0], [0, 2, 0], [1, 1, 1], [0, 0, 4], [2, 2, 2]], float)
    fold, y = np.array([0, 1, 0, 1, 2]), np.array([1, 1, 1, 0, 1], float)
    strong = np.array([[True, False, False], [True, True, True], [True, True, False], [False] * 3, [False] * 3])
    got = toxicity.derived(count, np.full(5, 10.0), y, fold, strong)
    # Fold 0 by the first word: shares .3 and .1, the others' median of (0, .2); fold 1: .2 over (.3, .3, .6); fold 2: .4 over (.3, .2, .2).
    assert got.tolist() == [[1, 1, 0], [1, 0, 0], [1, 0, 0], [0, 0, 0], [1, 1, 0]]


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] > 0).astype(float)
    y = np.column_stack([first, first * (x[:, 1] > 0)])
    c = toxicity.Chain(x, y, ["a", "b"])
    assert c.predict(x).shape == (400, 2) and len(c.models[1]) == len(c.models[0]) + 1
    assert not np.allclose(c.out_of_fold[:, 0], c.predict(x)[:, 0]) and ((c.predict(x)[:, 1] > 0.5) == (y[:, 1] > 0)).mean() > 0.9


def test_toxicity_awkward(spark, awkward, nothing, toxic_corpus):
    _, labels = toxic_corpus
    assert toxicity.toxicity(awkward, labels).count() == awkward.count()
    assert toxicity.toxicity(nothing, labels).count() == 0
    none = toxicity.toxicity(awkward, labels.where("false"))
    assert none.where("rejected").count() == 0 and none.count() == awkward.count()


@pytest.mark.parametrize("table", ["documents"])
def test_quality_and_language_on_given_tables(spark, table):
    docs, labels = spark.read.parquet(f"{TABLES}/{table}.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    ids = labels.where("quality is not null").select("doc_id", "quality")
    held = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0)
    got = quality.quality(docs, ids.join(held, "doc_id", "left_anti")).join(held, "doc_id")
    right = got.where((F.col("quality") == 1) == F.col("keep")).count()
    assert right / got.count() > 0.97
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    found = langid.identify(docs, remainder != 2).join(docs.select("doc_id", "lang"), "doc_id").where(remainder == 2)
    assert found.where(F.col("lang") == F.col("lang_pred")).count() / found.count() > 0.98
    assert found.where("score < 0 or score > 1").count() == 0


def plain_cotraining(x, y, pool, rounds, growth, sure):
    """The rounds in plain Python over lists of rows: who teaches whom what, and the final scores."""
    n, width = len(y), quality.WIDTH
    mean, spread = x.mean(0), x.std(0) + 1e-3
    scale = lambda r: (r - mean) / spread
    apart, dealt = set(), {0: 0, 1: 0}
    for i in sorted(range(n), key=lambda i: (y[i], i)):  # every fourth row in the order of classes
        if sum(dealt.values()) % 4 == 0:
            apart.add(i)
        dealt[int(y[i])] += 1
    part = lambda r, view: scale(r)[:width] if view == 0 else scale(r)[width:]
    taught = [[(part(x[i], v), y[i]) for i in range(n) if i not in apart] for v in (0, 1)]
    fit = lambda rows: base.fit_logistic(np.array([r for r, _ in rows]), np.array([v for _, v in rows], float), 1.0)
    free = {r.tobytes(): r.astype(float) for r in pool}
    for r in x:
        free.pop(r.astype("<f4").tobytes(), None)
    models = [fit(t) for t in taught]
    for _ in range(rounds):
        said = [{}, {}]
        for view in (0, 1):
            p = {k: float(base.sigmoid(part(r, view) @ models[view][:-1] + models[view][-1])) for k, r in free.items()}
            for label in (1, 0):
                best = sorted(p, key=lambda k: (-(p[k] if label else 1 - p[k]), k))[:growth]
                said[1 - view] |= {k: label for k in best if (p[k] if label else 1 - p[k]) >= sure}
        clash = {k for k in said[0].keys() & said[1].keys() if said[0][k] != said[1][k]}
        for view in (0, 1):
            taught[view] += [(part(free[k], view), label) for k, label in sorted(said[view].items()) if k not in clash]
        for k in (said[0].keys() | said[1].keys()) - clash:
            del free[k]
        models = [fit(t) for t in taught]
    own = sorted(apart)
    raw = lambda r: [part(r, v) @ models[v][:-1] + models[v][-1] for v in (0, 1)]
    held = np.array([raw(x[i]) for i in own])
    platt = [base.fit_logistic(held[:, [v]], y[own], 0.1) for v in (0, 1)]
    z = lambda r: np.array([np.clip(raw(r)[v] * platt[v][0] + platt[v][1], -12, 12) for v in (0, 1)])
    joint = base.fit_logistic(np.array([z(x[i]) for i in own]), y[own], 0.1)
    return [len(t) - len(x) + len(own) for t in taught], [float(base.sigmoid(z(r.astype(float)) @ joint[:-1] + joint[-1])) for r in pool]


def test_views_teach_each_other_as_in_plain_python(spark):
    rng = np.random.default_rng(6)
    n, m = 80, 900
    y = (np.arange(n + m) % 2).astype(float)
    x = (rng.normal(size=(n + m, quality.ALL)) * 0.3).astype("<f4")
    x[:, 0] += 2 * y
    x[:, quality.WIDTH] += 2 * y
    x[n + 500 :] = x[n + 100]  # many copies
    rows = spark.createDataFrame([(i, x[i].tobytes()) for i in range(n + m)], "doc_id long, x binary").repartition(7)
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "doc_id long, quality int")
    model = quality.train(rows, labels, rounds=3, growth=40, sure=0.9)
    taught, want = plain_cotraining(x[:n].astype(float), y[:n], x, 3, 40, 0.9)
    assert model.taught == taught and min(taught) > 50
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, model).collect()}
    assert np.allclose([got[i] for i in range(n + m)], want, atol=1e-6)
    assert np.mean([(got[i] > 0.5) == (y[i] > 0) for i in range(n, n + 500)]) > 0.95


def test_quality_awkward(spark, awkward, nothing):
    labels = awkward.where("doc_id >= 20").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.quality(awkward, labels).count() == awkward.count()
    assert quality.quality(nothing, labels).count() == 0
    flat = quality.quality(awkward, labels.where("false"))
    assert flat.select("score").distinct().count() == 1


def test_language_awkward(spark, awkward, nothing):
    rows = langid.identify(awkward, F.col("doc_id") >= 20).collect()
    assert len(rows) == awkward.count()
    said = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert said[1] == said[2] == said[3] == said[4] == "und" and said[20] in ("en", "de")
    assert langid.identify(nothing, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, F.lit(False)).collect()} == {"und"}
    one = langid.identify(awkward, F.col("lang") == "en").where("doc_id = 14").first()
    assert one["lang_pred"] == "en"


def test_prediction_ignores_held_out_labels(spark, awkward):
    usable = F.col("doc_id") % 2 == 0
    other = awkward.withColumn("lang", F.when(usable, F.col("lang")).otherwise(F.lit("xx")))
    a = sorted(map(str, langid.identify(awkward, usable).collect()))
    assert a == sorted(map(str, langid.identify(other, usable).collect()))


def test_repeated_lines_count_at_every_size():
    lines = [f"line {k} of a page" for k in range(10)] * 2
    short, long = "\n".join(lines), "\n".join(line + " with more words" * 2000 for line in lines)
    assert len(long) > 4 * base.PIECE
    assert quality.repeated_lines(short.encode()) == quality.repeated_lines(long.encode()) == 0.5
    junk = ("the same line\n" * 20_000).strip()
    assert len(junk) > base.PIECE
    h = base.WordHasher()
    at = len(quality.SIGNS) + 11
    assert quality.text_view(h, short)[at] == quality.text_view(h, long)[at] == 0.5 and quality.text_view(h, junk)[at] > 0.9999
    for t in ("", "a", "a\n", "\n\n", "a\nb\na"):
        lines = t.encode().split(b"\n")
        assert quality.repeated_lines(t.encode()) == 1 - len(set(lines)) / len(lines)


def test_chain_decides_otherwise_than_one_model():
    """The label is either of two earlier categories: a linear model of the counts alone can't say it, the chain's last one can."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 5, (600, 2)).astype(float)
    a, b = x[:, 0] >= 3, x[:, 1] >= 3
    y = np.column_stack([a, b, a | b]).astype(float)
    c = toxicity.Chain(x, y, ["severe", "varied", "toxic"])
    alone = base.fit_logistic(x, y[:, 2], 0.1)
    by_chain, by_one = c.predict(x)[:, 2] > 0.5, x @ alone[:-1] + alone[-1] > 0
    assert (by_chain != by_one).sum() > 20
    assert (by_chain == (a | b)).mean() > (by_one == (a | b)).mean() + 0.03


def test_most_confident_rows_are_ranked_in_two_levels(spark):
    """Many tasks, each with its own best rows: the same rows as one sort of all, however they are cut."""
    rng = np.random.default_rng(3)
    x = rng.random((3000, quality.ALL)).astype("<f4")
    x[40:80, 0] = x[:40, 0]
    model = quality.CoTrained(x[:200].astype(float), (x[:200, 0] > 0.5).astype(float))
    data = [r.tobytes() for r in x]
    d = spark.createDataFrame([(b,) for b in data + data[:500]], "x binary").repartition(40)
    used = set(data[100:120])
    left = [b for b in data if b not in used]
    p = dict(zip(left, model.probabilities(quality.unpacked(left)), strict=True))
    want = set()
    for view in (0, 1):
        for label in (0, 1):
            sure = {b: float(p[b][view] if label else 1 - p[b][view]) for b in left}
            want |= {(view, label, b) for b in sorted((b for b in left if sure[b] >= 0.5), key=lambda b: (-sure[b], b))[:20]}
    for pieces in (1, 7, 256):
        assert set(quality.most_confident(d, model, used, 20, 0.5, pieces)) == want
