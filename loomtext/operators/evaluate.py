"""Outputs against references, variants and runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.functions.once import once
from loomtext.functions.text import strip
from loomtext.operators.apply import lines, stripped_lines


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, as the standard library's sequence matcher finds them: meant for lines."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n).otherwise(1.0)


def aligned_lines(output: DataFrame, expected: DataFrame, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, line_no, output, expected): stripped lines that aren't blank (of those, the ones that `only` holds for) side by side; null where a side has no more."""
    a = lines(output, only=only).withColumnRenamed("line", "output")
    b = lines(expected, only=only).withColumnRenamed("line", "expected")
    return a.join(b, ["doc_id", "line_no"], "full_outer")


def side_by_side(output: Column, expected: Column) -> Column:
    """array<struct<output, expected>> of two arrays of lines."""
    return F.zip_with(output, expected, lambda o, e: F.struct(o.alias("output"), e.alias("expected")))


def paired_lines(docs: DataFrame, output: str, expected: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """aligned_lines of two columns of one table: no join, no shuffle."""
    both = side_by_side(stripped_lines(F.col(output), only), stripped_lines(F.col(expected), only))
    return docs.select("doc_id", F.posexplode(both).alias("line_no", "x")).select("doc_id", "line_no", "x.output", "x.expected")


def line_accuracy(pairs: DataFrame, by: list[str] = ("doc_id",)) -> DataFrame:
    """by, same, total, accuracy: lines equal at the same place, as a share of the expected lines."""
    there = F.col("expected").isNotNull()
    r = pairs.groupBy(*by).agg(F.sum((there & F.col("output").eqNullSafe(F.col("expected"))).cast("long")).alias("same"), F.sum(there.cast("long")).alias("total"))
    return r.withColumn("accuracy", F.when(F.col("total") > 0, F.col("same") / F.col("total")).otherwise(0.0))


def line_metrics(pairs: DataFrame, content: DataFrame | None = None, by: list[str] = ("doc_id",), similarity=edit_similarity) -> DataFrame:
    """total, exact, fuzzy (> 0.9), content (> 0.8), similarity, differing and headline (the greater of fuzzy and content).

    Shares are of the lines of the longer side. `content` has the lines of content
    alone, aligned among themselves; without it, or where there are none, that
    share is 0. Equal lines are similar by 1, and only others are compared;
    similarity is the mean over lines that both sides have.
    """
    rows = pairs.select(*by, "output", "expected", F.lit(False).alias("_of_content"))
    if content is not None:
        rows = rows.unionByName(content.select(*by, "output", "expected", F.lit(True).alias("_of_content")))
    return _measured(rows, by, similarity)


def paired_metrics(docs: DataFrame, output: str, expected: str, only: Callable[[Column], Column], similarity=edit_similarity) -> DataFrame:
    """line_metrics of two columns of one table, with the lines that `only` holds for as content: texts are read once, and a document's pairs of both kinds stand together."""
    d = once(docs.select("doc_id", output, expected), _o=stripped_lines(F.col(output)), _e=stripped_lines(F.col(expected)))
    flagged = lambda pairs, of_content: F.transform(pairs, lambda x: F.struct(x["output"].alias("output"), x["expected"].alias("expected"), F.lit(of_content).alias("_of_content")))
    both = F.concat(flagged(side_by_side(F.col("_o"), F.col("_e")), False), flagged(side_by_side(F.filter("_o", only), F.filter("_e", only)), True))
    return _measured(d.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*"), ["doc_id"], similarity)


def _measured(rows: DataFrame, by: list[str], similarity) -> DataFrame:
    """line_metrics of pairs of lines, those of content marked by `_of_content`."""
    both = F.col("output").isNotNull() & F.col("expected").isNotNull()
    equal = F.col("output").eqNullSafe(F.col("expected"))
    compared = F.when(both & ~equal, similarity(F.when(both & ~equal, F.col("output")), F.when(both & ~equal, F.col("expected"))))
    rows = rows.select(*by, "_of_content", equal.alias("equal"), F.when(equal, 1.0).otherwise(compared).alias("s"))
    line = ~F.col("_of_content")
    number = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    share = lambda c, of: F.coalesce(F.try_divide(number(c & of), number(of)), F.lit(0.0))
    r = rows.groupBy(*by).agg(
        number(line).alias("total"),
        share(F.col("equal"), line).alias("exact"),
        share(F.col("s") > 0.9, line).alias("fuzzy"),
        F.avg(F.when(line, F.col("s"))).alias("similarity"),
        number(line & ~F.col("equal")).alias("differing"),
        share(F.col("s") > 0.8, F.col("_of_content")).alias("content"),
    )
    r = r.where("total > 0")
    for key in by:  # rows without a key meet no content
        r = r.withColumn("content", F.when(F.col(key).isNotNull(), F.col("content")).otherwise(0.0))
    return r.withColumn("headline", F.greatest("fuzzy", "content"))


def flattened(text: Column) -> Column:
    """A text as one line for the comparison of whole texts: line breaks are spaces, two spaces one; stripped."""
    return strip(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def text_similarity(output: Column, expected: Column, similarity=edit_similarity) -> Column:
    return similarity(flattened(output), flattened(expected))


def changed_lines(pairs: DataFrame) -> DataFrame:
    """The line differences as rows: sign - for the expected side, + for the output."""
    d = pairs.where(~F.col("output").eqNullSafe(F.col("expected")))
    side = F.array(F.struct(F.lit("-").alias("sign"), F.col("expected").alias("line")), F.struct(F.lit("+").alias("sign"), F.col("output").alias("line")))
    return d.select("doc_id", "line_no", F.explode(side).alias("x")).select("doc_id", "line_no", "x.sign", "x.line").where("line is not null")


def version_key(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def ranked(runs: DataFrame, measure: str = "similarity") -> DataFrame:
    """runs with `rank`: best first, failed runs (null measure) last, ties by run_no. One task sorts them: runs are experiments, a row each, not documents."""
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(measure), "run_no")))


def best_run(runs: DataFrame, measure: str = "similarity") -> DataFrame:
    """The best run, the first of equals."""
    row = F.struct(*runs.columns)
    return runs.where(F.col(measure).isNotNull()).agg(F.max_by(row, F.struct(F.col(measure), -F.col("run_no"))).alias("r")).select("r.*")


def last_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_no")).limit(k)


def improvement(runs: DataFrame, by: list[str], measure: str = "similarity") -> DataFrame:
    """runs with the change of the measure since the run before, within by."""
    w = Window.partitionBy(*by).orderBy("ts", "run_no")
    return runs.withColumn("change", F.col(measure) - F.lag(measure).over(w))


def compared(runs: DataFrame, key: str, a: str, b: str, measures: list[str]) -> DataFrame:
    """measure, a, b, delta, better: two versions' means side by side."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures))
    rows = runs.where(F.col(key).isin(a, b)).select(key, F.explode(each).alias("x")).groupBy("x.measure").pivot(key, [a, b]).agg(F.avg("x.v"))
    rows = rows.select("measure", F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).withColumn("delta", F.col("b") - F.col("a"))
    return rows.withColumn("better", F.when(F.col("delta") > 0, b).when(F.col("delta") < 0, a).otherwise("same"))


def variants(docs: DataFrame, table: DataFrame, most: int = 1000) -> DataFrame:
    """Every document under every variant. The table of variants is counted first: more than `most` are refused."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} variants")
    return docs.join(F.broadcast(table))


def grid(docs: DataFrame, knobs: dict[str, list], prepared: tuple[str, Callable[[Column, object], Column]], measures: dict[str, Callable[[Column], Column]], most: int = 1000) -> DataFrame:
    """The knobs, `level` and the measures' sums: every combination of the knobs' values, each value of each knob by itself, and all; knobs that are summed over are null.

    The texts are read once for all variants. `prepared` is a knob and what it
    makes of a text, worked out once for each of its values; a measure is made of
    that and the other knobs' columns. Rows without texts are what gets one row for
    each variant, and they are summed in the tasks before anything is shuffled.
    """
    n = 1
    for values in knobs.values():
        n *= len(values)
    if n > most:
        raise ValueError(f"more than {most} variants")
    name, make = prepared
    rows = docs.select(F.explode(F.array(*(F.struct(F.lit(v).alias(name), make(F.col("text"), v).alias("_made")) for v in knobs[name]))).alias("_v")).select(f"_v.{name}", "_v._made")
    for other, values in knobs.items():
        if other != name:
            rows = rows.withColumn(other, F.explode(F.array(*map(F.lit, values))))
    each = rows.groupBy(*knobs).agg(*(F.sum(f(F.col("_made"))).cast("long").alias(m) for m, f in measures.items()))
    keys = [F.col(c) for c in knobs]
    sets = [keys, *([c] for c in keys), []]
    return each.groupingSets(sets, *keys).agg(F.grouping_id().cast("long").alias("level"), *(F.sum(m).cast("long").alias(m) for m in measures)).select(*knobs, "level", *measures)
