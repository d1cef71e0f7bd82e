import math
import zlib

import xxhash
from pyspark.sql import functions as F

from loomtext.llm import sharding as S


def test_whole_table(spark, awkward):
    rows = S.shard_documents(awkward, parts=4).collect()
    assert len(rows) == awkward.count()
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    again = S.shard_documents(awkward.repartition(3), parts=4).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_spread_and_growth(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"))
    tree = S.balanced_tree()
    r = S.assign(S.assign(d, "doc_id", tree), "doc_id", S.grown(tree), "g").groupBy("shard", "g").count().collect()
    sizes = {k: sum(x["count"] for x in r if x["shard"] == k) for k in range(16)}
    assert min(sizes.values()) > 1050 and max(sizes.values()) < 1450
    moved = sum(x["count"] for x in r if x["shard"] != x["g"])
    assert all(x["g"] in (x["shard"], 16) for x in r) and 950 < moved < 1400


def test_weights_and_confined_movement(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"))
    tree = S.balanced_tree()
    heavier = [x._replace(weight=3.0) if x.shard == 0 else x for x in tree]
    r = S.assign(S.assign(d, "doc_id", tree, "a"), "doc_id", heavier, "b").groupBy("a", "b").count().collect()
    into = sum(x["count"] for x in r if x["b"] == 0)
    assert abs(into - 20_000 * 3 / 18) < 400
    # Only the heavier region gains from others; between the other regions nothing moves.
    region = {x.shard: x.region for x in tree}
    assert all(region[x["a"]] == region[x["b"]] or region[x["b"]] == region[0] for x in r)


def test_empty(spark, nothing):
    assert S.shard_documents(nothing).count() == 0


def test_no_python_in_the_plan(spark, awkward):
    plan = S.shard_documents(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_draw(key, name, weight):
    h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
    return -math.log(((h >> 12) + 0.5) / 2**52) / weight


def plain_shard(key, tree):
    """Region, rack and shard one after the other, each by the smallest draw of plain Python."""
    own = [x for x in tree if x.weight > 0]
    for level, name in ((lambda x: x.region, lambda x: x.region), (lambda x: x.rack, lambda x: f"{x.region}/{x.rack}"), (lambda x: x.shard, lambda x: f"{x.region}/{x.rack}/{x.shard}")):
        groups = {}
        for x in own:
            groups.setdefault(level(x), []).append(x)
        if len(groups) > 1:
            own = min(groups.values(), key=lambda g: plain_draw(key, name(g[0]), sum(x.weight for x in g)))
    return own[0].shard


def test_draws_against_plain_python(spark):
    d = spark.createDataFrame([(k, "x" * ((k or 0) % 5)) for k in [None, -3, *range(400), 2**60]], "doc_id long, text string").repartition(3)
    uneven = [S.Leaf("a", "k", 0, 2.0), S.Leaf("a", "k", 1), S.Leaf("a", "l", 2, 0.5), S.Leaf("b", "k", 3, 4.0), S.Leaf("b", "m", 4, 0.0), S.Leaf("c", "k", 5)]
    for tree in (S.balanced_tree(), uneven):
        for r in S.shard_documents(d, tree, parts=3).collect():
            key = "null" if r["doc_id"] is None else str(r["doc_id"])
            assert (r["shard"], r["grown_shard"]) == (plain_shard(key, tree), plain_shard(key, S.grown(tree)))


def test_null_ids_share_no_piece(spark):
    """20,000 rows without an id: one shard by their key, slots without gaps, and no piece holds more than a few of them."""
    from pyspark.sql import functions as F

    d = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    d = d.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))).repartition(4)
    out = S.shard_documents(d)
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last")).collect()
    assert all(r["n"] == r["slots"] == r["last"] + 1 and r["first"] == 0 for r in got) and sum(r["n"] for r in got) == 20_500
    own = [F.col(c) for c in ("doc_id", "text_crc32", "size")]
    piece = F.pmod(F.xxhash64(F.struct(*own)), F.lit(512))
    assert out.where("doc_id is null").groupBy(piece).count().agg(F.max("count")).first()[0] < 120
