import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomtext.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(split(t))) for d, t in docs]
    some = [(d, c) for d, c in counts if c]
    total, words = len(some), sum(sum(c.values()) for _, c in some)
    df = Counter(w for _, c in some for w in c)
    out = set()
    texts = {}
    for i, t in items:
        if t is not None and (i not in texts or t < texts[i]):
            texts[i] = t
    for i, t in texts.items():
        scores = []
        for d, c in some:
            n = sum(c.values())
            m = 10 + (90 * n * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(split(t)) if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out |= {(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(seed, n, words=300):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return rng, names, weights, [(k, " ".join(rng.choices(names, weights, k=rng.randint(0, 80)))) for k in range(n)]


def test_brute_force(spark):
    rng, names, weights, docs = corpus(1, 400)
    items = [(k, " ".join(rng.choices(names, weights, k=rng.randint(1, 40)))) for k in range(25)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"stages": 1}, {"stages": 7, "slice_size": 30, "chunk_terms": 60}):
        assert {tuple(r) for r in lexical.search(d, i, **options).collect()} == brute(docs, items)


def test_accumulators_are_pruned_without_loss():
    """Contributions in any split into stages give the same best ones, with fewer documents held."""
    rng = np.random.default_rng(3)
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    gains = [rng.integers(0, top, 500) * (rng.random(500) < share) for top, share in ((90_000, 0.03), (20_000, 0.2), (900, 0.7), (50, 1.0))]
    tops = [int(g.max()) for g in gains]
    rows = np.arange(500, dtype=np.int64) * 2
    acc, held = none, []
    for s, g in enumerate(gains):
        there = g > 0
        acc = lexical.accumulated(acc, (rows[there], rows[there] // 2, g[there]), sum(tops[s:]), sum(tops[s + 1 :]), 10)
        held.append(len(acc[0]))
    total = np.sum(gains, axis=0)
    top = lexical.best_of(*acc, 10)
    assert list(zip(acc[2][top], acc[1][top])) == [(total[i], i) for i in sorted(range(500), key=lambda i: (-total[i], i))[:10]]
    assert held[-1] < 100


def test_ties_hot_term_and_repeats(spark):
    docs = [(k % 40 if k % 3 else None, "hot same") for k in range(120)] + [(500 + k, f"hot rare{k}") for k in range(10)]
    items = [(1, "HOT"), (2, "hot rare3 same"), (2, "a smaller text: hot"), (None, "rare5"), (3, None), (4, "..."), (5, "unknown")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slice_size=16)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, listed(docs, items)))


def listed(docs, items):
    """brute as a list: rows of one doc_id may come more than once."""
    out = []
    for i in {i for i, _ in items}:
        text = min((t for j, t in items if j == i and t is not None), default=None)
        single = brute([(k, t) for k, (_, t) in enumerate(sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)))], [(i, text)])
        ids = [d for d, _ in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))]
        out += [(i, r, ids[k], s) for i, r, k, s in single]
    return out


def test_filter_lets_all_item_terms_through(spark):
    names = [f"term{k}é" for k in range(3000)] + ["你好", "ſ", "k"]
    bits = lexical.filter_of(spark.createDataFrame([(n,) for n in names], "term string"))
    assert all(bits[lexical.hashed(n.encode()) >> 3] >> (lexical.hashed(n.encode()) & 7) & 1 for n in names)
    assert sum(bits[lexical.hashed(f"no{k}".encode()) >> 3] >> (lexical.hashed(f"no{k}".encode()) & 7) & 1 for k in range(3000)) < 20


def test_awkward(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "Same TEXT for all"), (2, "größe über 你好 é"), (3, rows[0][1] or "one"), (4, "one two th er on"), (5, None)]
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, row int")
    got = lexical.search(awkward.withColumn("row", F.lit(1)).withColumn("term", F.lit("x")), i)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, listed(rows, items)))
    assert lexical.search(nothing, i).collect() == []
    assert lexical.search(awkward, i.where("false")).collect() == []
