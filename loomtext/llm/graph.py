"""Connected components of a table of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import discard, join_with_hot, written


def components(links: DataFrame, name: str = "components", rounds: int = 60, hub: int = 10_000) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: a grouping whose minimum is
    combined before the shuffle, and a join of the edges with it. Hubs (nodes of
    more than `hub` edges and of a quarter of a partition's share) meet their
    minimum by broadcast, so that no task gets all edges of a hub. Every step is
    written to the shared folder, which ends its lineage; the tables before it go.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(rounds):
        # Large star: every larger neighbour of u moves to the smallest node of u's neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        met = join_with_hot(both.where("v > u"), least, "u", "n", hub)
        large = written(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_with_hot(large, least, "u", "n", hub).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(edges)
        discard(large)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
