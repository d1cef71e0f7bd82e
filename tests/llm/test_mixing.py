import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.llm import mixing as M

from .conftest import words


def brute_targets(sizes, factor=1.5, weights=(3, 1, 2), most=2.0):
    """sizes: source -> words. Shares by weight; what is over a cap is shared again until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, factor * sum(sizes.values()), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_copies(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "Z", None])
        rows.append((k, source, " ".join(words(rng, rng.choice([0, 3, 3, 40, 200, 900 if k % 97 == 0 else 7])))))
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    got = M.mix(d).collect()
    assert len(got) == 900
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, _, t in rows}
    totals: dict = {}
    for k, s, _ in rows:
        totals[s] = totals.get(s, 0) + size[k]
    want = brute_targets(totals)
    taken: dict = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[r["source"]] and 0 <= r["copies"] <= 2
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and 0 <= r["rate"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3
    assert sum(want.values()) == pytest.approx(1.5 * sum(totals.values()))
    again = M.mix(d.repartition(2)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_rates_are_exponential_in_size(spark):
    import math

    rows = [(k, "a", "w " * (k % 9 + 1)) for k in range(300)] + [(1000 + k, "b", "w " * (k % 5 + 1)) for k in range(900)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("source = 'b'").select("size", "rate").distinct().collect()
    slope = {round(math.log(r["rate"]) / r["size"], 9) for r in got if r["rate"] < 2}
    assert len(slope) == 1 and len(got) == 5


def test_awkward(spark, awkward, nothing):
    got = M.mix(awkward)
    assert got.count() == awkward.count() and "units" in got.columns
    assert {r["copies"] for r in got.where("size = 0").collect()} == {1}
    sums = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert all(r["t"] <= 2 * r["s"] for r in sums)
    assert M.mix(nothing).count() == 0
    assert M.mix(awkward.where("doc_id in (1, 2)")).count() == 2


def test_clashing_names_and_sizes_given(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), "w " * rng.randint(1, 30), k % 3, "x", 1, "y", k, 2.5, 7) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, _source int, _size string, _piece int, _row string, _own int, total double, n int").repartition(3)
    got = M.mix(d)
    assert got.columns == [*d.columns, "size", "source_size", "target", "rate", "copies"]
    assert sorted(map(tuple, got.select(*d.columns).collect())) == rows
    narrow = d.select("doc_id", "source", M.words(d["text"]).alias("words"), F.xxhash64("text").alias("tie"))
    same = M.mix(narrow, size="words", tie="tie")
    columns = ["doc_id", "size", "source_size", "target", "rate", "copies"]
    assert sorted(map(tuple, same.select(*columns).collect())) == sorted(map(tuple, got.select(*columns).collect()))


def test_many_sources(spark):
    """As many sources as documents: a histogram cell each."""
    rows = [(k, f"s{k:05}", "w " * (k % 4)) for k in range(3000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)).collect()
    want = brute_targets({s: len(t.split()) for _, s, t in rows})
    assert len(got) == 3000 and all(r["target"] == pytest.approx(want[r["source"]], rel=1e-9) for r in got)


def test_rows_without_an_id_are_dealt_out(spark):
    """20,000 rows of one source and size without an id: the target is met, no row is taken more than twice, and reruns agree."""
    d = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("w w t"), F.col("id")).alias("text"))
    d = d.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("x y z u v").alias("text"))).repartition(5)
    got = M.mix(d).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 20_000, "b": 3000}
    assert all(abs(r["taken"] - r["target"]) <= 5 and r["most"] <= 2 for r in got)
    rows = lambda x: sorted((r["source"], r["text"], r["copies"]) for r in M.mix(x).select("source", "text", "copies").collect())
    assert rows(d) == rows(d.repartition(3))
