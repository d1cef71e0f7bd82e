"""Statistics of cleaning, as long tables (doc_id, step, key, value) and sums of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_stats(df: DataFrame, steps: dict[str, dict[str, Column]], keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, step, key, value: one row for each count that is there (not null)."""
    items = [F.struct(F.lit(step).alias("step"), F.lit(key).alias("key"), value.cast("long").alias("value")) for step, own in steps.items() for key, value in own.items()]
    there = F.filter(F.array(*items), lambda x: x["value"].isNotNull())
    return df.select(*keep, F.explode(there).alias("s")).select(*keep, "s.step", "s.key", "s.value")


def combined(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each document and step, one column for each key; a key is null where its step changed nothing."""
    return stats.groupBy("doc_id", "step").pivot("key", keys).agg(F.sum("value"))


def totals(stats: DataFrame, by: list[str]) -> DataFrame:
    return stats.groupBy(*by, "step", "key").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("docs"))


def subtotals(stats: DataFrame, by: list[str]) -> DataFrame:
    """Sums over by, its prefixes and all; level 0 is the finest."""
    return stats.rollup(*by).agg(F.sum("value").alias("total"), F.grouping_id().alias("level"))


def histogram(items: DataFrame, column: str) -> DataFrame:
    """column, n: how often each value that isn't null occurs, largest first."""
    return items.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy(F.desc("n"), column)


def growth(pairs: DataFrame, phases: list[tuple[str, str, str]], by: list[str] = ()) -> DataFrame:
    """by, phase, delta, ratio, shown: change of length from one text column to the next, over the corpus."""
    each = F.array(*(F.struct(F.lit(p).alias("phase"), F.length(b).cast("long").alias("b"), F.length(a).cast("long").alias("a")) for p, a, b in phases))
    rows = pairs.select(*by, F.explode(each).alias("x")).groupBy(*by, "x.phase").agg(F.sum(F.col("x.b") - F.col("x.a")).alias("delta"), F.sum("x.a").alias("_a"))
    ratio = F.when(F.col("_a") > 0, F.col("delta") / F.col("_a")).otherwise(0.0)
    return rows.select(*by, "phase", "delta", ratio.alias("ratio"), F.format_string("%+.2f%%", 100 * ratio).alias("shown"))


def fixer_stats(nodes: DataFrame) -> DataFrame:
    """doc_id, nodes_seen, spans_total (asked for), spans_fixed, spans_rejected, the rejections by reason and file_growth_ratio, of rewritten nodes (text, original, fixed, reject)."""
    reasons = ["timeout", "non_response", "forbidden_tokens", "growth_limit", "empty_or_non_text"]
    count = lambda c: F.sum(c.cast("long"))
    return nodes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("nodes_seen"),
        F.count("fixed").alias("spans_total"),
        F.count_if("fixed").alias("spans_fixed"),
        F.count_if(~F.col("fixed")).alias("spans_rejected"),
        *(count(F.coalesce(F.col("reject") == r, F.lit(False))).alias(f"rejected_{r}") for r in reasons),
        F.when(F.sum(F.length("original")) > 0, F.sum(F.length("text") - F.length("original")) / F.sum(F.length("original"))).otherwise(0.0).alias("file_growth_ratio"),
    )


def detector_stats(suggestions: DataFrame, responses: DataFrame) -> DataFrame:
    """Of the whole run: model_calls, chunks_processed, suggestions_valid, suggestions_rejected, plan_size (distinct pairs of each document); 0 where there are none."""
    calls = responses.agg(F.count(F.lit(1)).alias("model_calls"), F.count_if(F.col("error").isNull()).alias("chunks_processed"))
    pairs = suggestions.groupBy("doc_id", "find", "replace").agg(F.count_if("valid").alias("v"), F.count_if(~F.col("valid")).alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    said = pairs.agg(total("v").alias("suggestions_valid"), total("r").alias("suggestions_rejected"), F.count_if(F.col("v") > 0).alias("plan_size"))
    return calls.crossJoin(said)  # one row each
