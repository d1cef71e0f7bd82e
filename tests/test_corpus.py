import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.operators import detect, evaluate
from loomtext.streaming import incremental


@pytest.mark.parametrize("buckets", [1, 7, 1 << 14])
def test_problem_topk_against_counting(spark, tmp_path, buckets):
    """Hot texts, many rare ones, ties, null reasons and texts: the same ten as counting everything gives."""
    rng = random.Random(buckets)
    rows = [(rng.randrange(300), f"w{min(int(rng.paretovariate(0.7)), 900)}", rng.choice(["A", "B", None])) for _ in range(4000)]
    rows += [(k, "HOT", "A") for k in range(1500)] + [(1, None, "B")] * 40 + [(2, "x", "ONE"), (2, "y", "ONE"), (None, "y", "ONE")]
    items = spark.createDataFrame(rows, "doc_id long, find string, reason string").withColumn("item_no", F.lit(0))
    got = {tuple(r) for r in detect.problem_topk(items, str(tmp_path / "p"), buckets=buckets).select("reason", "find", "n", "docs", "rank").collect()}
    n, docs = Counter((w, f) for _, f, w in rows), Counter((w, f) for _, f, w in set(rows))
    want = set()
    for reason in {w for w, _ in n}:
        own = sorted(((-c, f is not None, f or "") for (w, f), c in n.items() if w == reason))[:10]
        want |= {(reason, f if there else None, -c, docs[reason, f if there else None], k + 1) for k, (c, there, f) in enumerate(own)}
    assert got == want


def test_problem_topk_of_nothing(spark, tmp_path):
    items = spark.createDataFrame([], "doc_id long, find string, reason string")
    assert detect.problem_topk(items, str(tmp_path / "p")).count() == 0


def test_grid_reads_texts_once(spark, tmp_path):
    spark.createDataFrame([(0, "aa bb", 1), (1, None, 2), (2, "", 3), (3, "abcdef", 4)], "doc_id long, text string, width int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    knobs = {"width": [2, 4], "prompt": ["p", "qq"], "most": [1, 9]}
    measures = {"chunks": F.coalesce, "sent": lambda n: n * F.length("prompt"), "kept": lambda n: F.least(n, F.col("most"))}
    out = evaluate.grid(docs, knobs, ("width", lambda text, w: F.coalesce(F.ceil(F.length(text) / F.lit(w)), F.lit(0)).cast("long")), measures)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {(r["width"], r["prompt"], r["most"]): (r["chunks"], r["sent"], r["kept"]) for r in out.collect()}
    n = {2: [3, 0, 0, 3], 4: [2, 0, 0, 2]}
    assert len(got) == 8 + 6 + 1
    for w in n:
        for p in knobs["prompt"]:
            for m in knobs["most"]:
                assert got[w, p, m] == (sum(n[w]), sum(n[w]) * len(p), sum(min(v, m) for v in n[w]))
    assert got[2, None, None][0] == 4 * 6 and got[None, None, None][0] == 4 * 10 and got[None, "qq", None][1] == 2 * 2 * 10
    with pytest.raises(ValueError):
        evaluate.grid(docs, {"width": list(range(1001))}, ("width", lambda text, w: F.length(text)), {"chunks": F.coalesce})


def test_sums_last_through_restarts_and_failures(spark, tmp_path):
    """Three deliveries; the second one's batch fails after its sums were written and is run again; what comes late is listed, not summed."""
    schema = "doc_id long, step string, key string, value long, ts string"
    parts = [
        [(0, "s", "k", 1, "2025-01-01 10:00:00"), (1, "s", "k", 2, "2025-01-01 15:00:00")],
        [(2, "s", "k", 4, "2025-01-01 14:30:00"), (3, "s", "k", 8, "2025-01-01 10:30:00"), (4, "s", None, 16, "2025-01-01 18:00:00"), (5, "s", "k", None, None)],
        [(6, "s", "k", 32, "2025-01-01 16:59:00"), (7, "s", "k", 64, "2025-01-01 17:00:00"), (8, "t", "k", 128, "2024-12-31 00:00:00")],
    ]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frames = [spark.createDataFrame(p, schema).withColumn("ts", F.to_timestamp("ts")) for p in parts]
    go = lambda stats: incremental.lasting_sums(stats, out, state).awaitTermination()
    for number, d in enumerate(frames):
        d.write.mode("append").parquet(source)
        rows = incremental.arriving(spark, source, d.schema)
        if number == 1:
            with pytest.raises(Exception):  # noqa: B017, PT011
                go(rows.withColumn("value", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("value"))))
        go(rows)
    go(incremental.arriving(spark, source, frames[0].schema))  # nothing new
    got = {(str(r["hour"]), r["step"], r["key"]): (r["total"], r["late"]) for r in incremental.summed(spark, out).collect()}
    assert got == {
        ("2025-01-01 10:00:00", "s", "k"): (1, 1),
        ("2025-01-01 15:00:00", "s", "k"): (2, 0),
        ("2025-01-01 14:00:00", "s", "k"): (4, 0),
        ("2025-01-01 18:00:00", "s", None): (16, 0),
        ("2025-01-01 16:00:00", "s", "k"): (0, 1),
        ("2025-01-01 17:00:00", "s", "k"): (64, 0),
        ("2024-12-31 00:00:00", "t", "k"): (0, 1),
        ("None", "s", "k"): (0, 0),
    }
    late = spark.read.parquet(f"{out}/late")
    assert sorted(r["doc_id"] for r in late.collect()) == [3, 6, 8]
