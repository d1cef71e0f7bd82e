import random
import time

from pyspark.sql import functions as F

from loomtext.operators import apply


def entries(spark, finds):
    return spark.createDataFrame([(k, f, "r", "x") for k, f in enumerate(finds)], "item_no int, find string, replace string, reason string")


def test_hits_by_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé 你") for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, ""]
    finds = ["".join(rng.choice("abé 你") for _ in range(rng.randint(0, 5))) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted((i, k) for i, t in enumerate(texts) for k, f in enumerate(finds) if t is not None and f and f in t)
    for most in (1_000_000, 60):  # one automaton, or several
        got = apply.dictionary_hits(d, entries(spark, finds), most).select("doc_id", "item_no").collect()
        assert sorted(map(tuple, got)) == want


def test_fifty_thousand_entries_in_one_reading(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 9))) for _ in range(50_000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    e = entries(spark, words)
    d.count()
    plan = apply.dictionary_hits(d, e)._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
    began = time.time()
    n = apply.dictionary_hits(d, e).count()
    assert time.time() - began < 30 and n >= sum(len(set(t.split())) for t in texts)


def test_no_entries_and_other_types_of_ids(spark):
    d = spark.createDataFrame([("a", "some text")], "doc_id string, text string").withColumn("find", F.lit(1))
    assert apply.dictionary_hits(d, entries(spark, ["x"]).where("false")).collect() == []
    assert [tuple(r) for r in apply.dictionary_hits(d, entries(spark, ["text", "me te"])).orderBy("item_no").collect()] == [("a", 0, "text", "r", "x"), ("a", 1, "me te", "r", "x")]
