"""Mixing sources to target weights by entropy balancing.

Each source's target of words is its weight's share of `factor` times all
words, at most `most` times its own words; what a source cannot take is shared
again by weight among the others. The rates of its documents are those with
the least relative entropy against "every document once" whose expected words
meet the target and which stay in [0, most]:

    rate(doc) = min(most, exp(lambda * words / mean words of the source)).

lambda is the optimum of a convex dual with one variable for each source.
Newton steps for all sources at once are Spark aggregates over the histogram
(source, words) -> documents, which holds all that the dual depends on; every
step's lambdas are a written table.

Rounding: within a source, from long documents to short ones, a histogram
cell's copies are rate * documents rounded with the error of the cells before
carried along, so that the last error is about half the shortest document. A
cell's copies are dealt to its documents by rank.

Sizes are numbers of words. A histogram has few cells for a source: d distinct
sizes need d * (d - 1) / 2 words.

Defined cases: null and empty texts have size 0 and stay once; sources are
ordered by code point with null, a source of its own, last; a source of no
words has target 0; rows that repeat a doc_id are separate documents; an empty
table gives an empty result; other columns, of whatever names, are handed on.

Tasks that don't grow with the documents: the targets' sorted windows have a row
for each source; the rounding of a source sees its histogram.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.base import WORD, discard, written

KEY = ["_source", "_size"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~"))


def targets(sizes: DataFrame, factor: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(_source, total) -> with `target`. One row for each source goes through one sorted window."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(Window.orderBy("_source")) - 1, F.lit(len(weights))).cast("int") + 1)
    w = sizes.withColumn("w", weight).withColumn("cap", most * F.col("total")).withColumn("level", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("level", "_source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("goal", factor * F.sum("total").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    full_before, w_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # In order of level, a source is full while the rest at its level would not exceed the goal.
    w = w.withColumn("full", F.col("level") * (F.col("all_w") - w_before) + full_before <= F.col("goal"))
    left = F.col("goal") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    left_w = F.col("all_w") - F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(everything)
    return w.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / left_w)).select("_source", "total", "target", F.col("full").alias("full"))


def tilt(cells: DataFrame, goals: DataFrame, most: float, steps: int = 60, close: float = 1e-10) -> DataFrame:
    """(_source, total, target, full, mean, lam) by Newton steps, kept inside a bracket that every step narrows."""
    mean = cells.groupBy("_source").agg((F.sum(F.col("n") * F.col("_size")) / F.sum("n")).alias("mean"))
    state = goals.join(mean, "_source").withColumn("lam", F.when(F.col("target") > 0, F.log(F.col("target") / F.col("total"))).otherwise(0.0))
    state = state.withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("done", F.col("full") | (F.col("total") == 0))
    state = written(state, "tilt")
    x = F.col("_size") / F.col("mean")
    rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        sums = cells.join(state.where("not done").select("_source", "mean", "lam"), "_source").groupBy("_source")
        sums = sums.agg(
            F.sum(F.col("n") * F.col("_size") * F.least(rate, F.lit(most))).alias("value"),
            F.sum(F.when(rate < most, F.col("n") * F.col("_size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        s = state.join(sums, "_source", "left")
        off = F.col("value") - F.col("target")
        s = s.withColumn("lo", F.when(off < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
        s = s.withColumn("hi", F.when(off > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.greatest(F.lit(-4.0), F.least(off / F.col("slope"), F.lit(4.0)))
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        s = s.withColumn("done", F.col("done") | (F.abs(off) <= close * F.col("target")))
        middle = F.when((F.col("lo") > -1e6) & (F.col("hi") < 1e6), (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("lam") - F.signum(off) * (1 + F.abs("lam")))
        s = s.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(middle))
        before, state = state, written(s.select(*state.columns), "tilt")
        discard(before)
    return state


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of one source, from long documents to short ones, with the error carried along."""
    cells = cells.sort_values("_size", ascending=False)
    carry, out = 0.0, []
    for size, n, rate, most in zip(cells["_size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), cells["most"].tolist(), strict=True):
        want = n * rate + (carry / size if size else 0)
        copies = min(max(round(want), 0), int(n * most))
        carry += (n * rate - copies) * size
        out.append(copies)
    return cells.assign(copies=out)[["_source", "_size", "copies"]]


def mix(docs: DataFrame, factor: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, per_piece: int = 100_000, size: str | None = None, tie: str | None = None) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document).

    size, tie: columns that hold the number of words and a hash of the text, so
    that no text is needed; without them both come from `text`. Documents of one
    source and size are dealt copies in the order of doc_id and tie.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    n_words = docs[size] if size else words(docs["text"])
    order = docs[tie] if tie else F.xxhash64(docs["text"])
    # The columns handed on travel in one struct, where no name can clash.
    pieces = max(64, docs.count() // per_piece)
    # By text too: rows without an id are dealt out as all others.
    piece = F.pmod(F.xxhash64(docs["doc_id"], order), F.lit(pieces)).cast("int").alias("_piece")
    key = [source_key(docs["source"]).alias("_source"), n_words.cast("long").alias("_size"), piece]
    parts = written(docs.select(*key).groupBy(*KEY, "_piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    cells = written(parts.groupBy(*KEY).agg(F.sum("n").alias("n")), "cells")
    goals = targets(cells.groupBy("_source").agg(F.sum(F.col("n") * F.col("_size")).alias("total")), factor, weights, most)
    state = tilt(cells, goals, most)
    rate = F.when(F.col("full") & (F.col("_size") > 0), F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("_size") / F.greatest("mean", F.lit(1e-9)), F.lit(50.0))), F.lit(float(most))))
    rated = cells.join(state, "_source").select(*KEY, "n", rate.alias("rate"), F.lit(float(most)).alias("most"), "total", "target")
    copies = rated.groupBy("_source").applyInPandas(_round, "_source string, _size long, copies long")
    share = rated.join(copies, KEY)
    before = Window.partitionBy(*KEY).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    dealt = first.join(share, KEY).select(*KEY, "_piece", "_first", "rate", "total", "target", F.expr("copies div n").alias("_each"), F.expr("copies % n").alias("_more"))
    own = docs.select(F.struct(*(docs[c] for c in names)).alias("_own"), *key, docs["doc_id"].alias("_id"), order.alias("_tie"))
    numbered = own.withColumn("_row", F.row_number().over(Window.partitionBy(*KEY, "_piece").orderBy("_id", "_tie")))
    copies = F.col("_each") + F.when(F.col("_first") + F.col("_row") - 1 < F.col("_more"), 1).otherwise(0)
    return numbered.join(dealt, [*KEY, "_piece"]).select(
        *(F.col("_own").getField(c).alias(c) for c in names),
        F.col("_size").alias("size"),
        F.col("total").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        "rate",
        copies.cast("long").alias("copies"),
    )
