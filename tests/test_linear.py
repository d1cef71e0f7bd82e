"""Folds and cuts over very many spans: the same rows as plain Python, in about linear time."""

import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import spans
from loomtext.functions.once import collected, once
from loomtext.operators import apply


def test_masks_of_a_text_with_very_many_spans(spark):
    n = 40_000
    text = "".join(f"word{k} `code {k}` " for k in range(n)) + "end é"
    d = spark.createDataFrame([(1, text), (2, "no spans"), (3, None), (4, "")], "doc_id long, text string")
    began = time.time()
    d = once(d, found=spans.spans(F.col("text")))
    d = once(d, masked=spans.masked(F.col("text"), F.col("found")))
    d = d.withColumn("back", spans.unmasked(F.col("masked"), spans.mask_table(F.col("found"))))
    got = {r.doc_id: r for r in d.select("doc_id", "masked", "text", "back", F.size(spans.text_nodes(F.col("text"), F.col("found"))).alias("nodes")).collect()}
    took = time.time() - began
    assert got[1].masked == "".join(f"word{k} __MASKED_{k}__ " for k in range(n)) + "end é"
    assert all(r.back == r.text for r in got.values()) and got[1].nodes == n + 1 and got[2].nodes == 1
    assert took < 60


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_greedy_choice(spark, n):
    import random

    rng = random.Random(n)
    rows = sorted((a, a + rng.randint(1, 9)) for a in (rng.randrange(3 * n + 1) for _ in range(n)))
    kept, end = [], 0
    for a, b in rows:
        if a >= end:
            kept.append((a, b))
            end = b
    d = spark.createDataFrame([(rows,)], "s array<struct<start:int,end:int>>")
    got = d.select(spans.swept(F.col("s"), lambda x: x, "struct<start:int,end:int>").alias("k")).first().k
    assert [tuple(x) for x in got] == kept
    sums = d.select(collected(F.transform("s", lambda x: x["start"]), F.lit(0), lambda s, x: (s + x, F.array(s + x)), "int").alias("k")).first().k
    assert sums == [sum(r[0] for r in rows[: k + 1]) for k in range(n)]


def test_longest_matches_of_a_long_node(spark):
    n = 30_000
    rows = [(1, 0, k * 3, 2 + (k % 3), f"f{k % 7}", "r", "x") for k in range(n)]
    m = spark.createDataFrame(rows, "doc_id long, node_no int, offset int, length int, find string, replace string, reason string")
    began = time.time()
    r = apply.keep_longest(m).select(F.size("kept").alias("n"), "skipped").first()
    kept, end = 0, 0
    for _, _, at, size, *_ in rows:
        if at >= end:
            kept, end = kept + 1, at + size
    assert (r.n, r.skipped) == (kept, n - kept) and time.time() - began < 60


@pytest.mark.parametrize(
    "text,table",
    [
        ("a __MASKED_0__ b __MASKED_1__", {"__MASKED_0__": "x", "__MASKED_1__": "y"}),
        ("__MASKED_0____MASKED_1__", {"__MASKED_0__": "x", "__MASKED_1__": "y"}),
        ("__MASKED_1__MASKED_0__", {"__MASKED_0__": "x", "__MASKED_1__": "y"}),
        ("__MASKED_0__ __MASKED_7__", {"__MASKED_0__": "x", "__MASKED_1__": "y"}),
        ("__MASKED_1__", {"__MASKED_0__": "x", "__MASKED_1__": "__MASKED_0__"}),
        ("__MASKED_0__MASKED_5__", {"__MASKED_0__": "a __", "__MASKED_5__": "y"}),
        ("__MASKED_0__MASKED_1__", {"__MASKED_0__": "a __", "__MASKED_1__": "y"}),
        ("no masks", {}),
        ("__MASKED_10__ __MASKED_1__", {f"__MASKED_{k}__": f"v{k}" for k in range(11)}),
        ("__MASKED_99999999999__", {"__MASKED_0__": "x"}),
    ],
)
def test_one_pass_is_as_one_by_one(spark, text, table):
    want = text
    for key in sorted(table, key=lambda k: (-len(k), k)):
        want = want.replace(key, table[key])
    d = spark.createDataFrame([(text, table)], "text string, t map<string,string>")
    assert d.select(spans.unmasked(F.col("text"), F.col("t"))).first()[0] == want


def test_masked_edits_of_one_document_by_a_sweep(spark):
    import random

    rng = random.Random(1)
    m = [(rng.choice([1, 2, None]), rng.randrange(300), rng.randint(0, 5), k) for k in range(400)] + [(1, 5, 2, -1)] * 2
    r = [(rng.choice([1, 2, 3, None]), a, a + rng.randint(0, 9)) for a in (rng.randrange(300) for _ in range(25))] + [(1, None, 4)]
    matches, ranges = spark.createDataFrame(m, "doc_id long, offset int, length int, start int"), spark.createDataFrame(r, "doc_id long, start int, end int")
    want = [x for x in m if any(x[0] is not None and x[0] == d and a is not None and x[1] < b and a < x[1] + x[2] for d, a, b in r)]
    assert sorted(map(repr, map(tuple, apply.masked_edits(matches, ranges).collect()))) == sorted(map(repr, want))
    n = 50_000
    many = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 4).cast("int").alias("offset"), F.lit(2).alias("length"))
    wide = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 8).cast("int").alias("start"), (F.col("id") * 8 + 3).cast("int").alias("end"))
    began = time.time()
    assert apply.masked_edits(many, wide).count() == n // 2 and time.time() - began < 20


def test_validated_rewrites(spark):
    from loomtext.functions import validators

    rows = [("This has minor issues.", "This has minor issues!"), ("This is text.", "This is `code`."), ("Short.", "A much longer sentence with lots of extra words."), ("This is text.", ""), ("This is text.", "  This is text.  \n"), ("a", None)]
    d = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r.v) for r in d.select(validators.validated(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [(True, rows[0][1], ""), (False, rows[1][0], "forbidden_tokens"), (False, "Short.", "growth_limit"), (False, rows[3][0], "empty_or_non_text"), (True, "This is text.", ""), (False, "a", "empty_or_non_text")]
    assert d.select(validators.validated(F.col("a"), F.col("b"), tokens=False).alias("v")).collect()[1].v.text == "This is `code`."
