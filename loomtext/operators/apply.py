"""Applying plans to texts: first occurrence in order, all matches, dictionaries, offsets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.functions.once import once
from loomtext.functions.spans import stitched, swept
from loomtext.functions.validators import first_failure

ITEMS = "array<struct<item_no:int,find:string,replace:string>>"


def plans_by_doc(plan: DataFrame) -> DataFrame:
    """(doc_id, items): each document's plan in order of item_no."""
    item = F.struct(F.col("item_no").cast("int").alias("item_no"), "find", "replace")
    return plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("rejected", T.IntegerType())]))
def _folded(texts: pa.Array, finds: pa.Array, news: pa.Array) -> pa.Array:
    """Texts may have as many items as words, and each step makes a text anew: memory is copied, not signs counted."""
    out = []
    for text, find, new in zip(texts.to_pylist(), finds.to_pylist(), news.to_pylist(), strict=True):
        applied = 0
        for f, n in zip(find or (), new or (), strict=True):
            if text is not None and f is not None and f in text:
                applied += 1
                text = None if n is None else text.replace(f, n, 1)
        out.append((text, applied, len(find or ()) - applied))
    text, applied, rejected = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(applied, pa.int32()), pa.array(rejected, pa.int32())], ["text", "applied", "rejected"])


def folded(text: Column, items: Column) -> Column:
    """struct<text, applied, rejected>: the items applied in order, each to its first occurrence in what the ones before it left.

    An empty find text puts its replacement in front; an item without a find text is rejected.
    """
    return _folded(text, F.transform(items, lambda i: i["find"]), F.transform(items, lambda i: i["replace"]))


def apply_plan(docs: DataFrame, plan: DataFrame, **options) -> DataFrame:
    """apply_items with each document's items from a plan table, which meets the documents on a shuffle."""
    plans = plans_by_doc(plan).withColumnsRenamed({"doc_id": "_id", "items": "_plan"})
    d = docs.join(plans, docs["doc_id"] == plans["_id"], "left").drop("_id")
    return apply_items(d, "_plan", **options)


def apply_items(docs: DataFrame, items: str, **options) -> DataFrame:
    """docs with the edited text, replacements_applied, replacements_rejected, error (the validators' first) and skipped (no plan).

    `items` is the column of each document's own plan, null or an array in order;
    it goes. Map-only. If a validator fails, the original text stays and the
    counts are kept. Texts without items come to Python as nulls.
    """
    none = F.expr(f"cast(array() as {ITEMS})")
    d = docs.withColumn("_items", F.coalesce(items, none))
    some = F.size("_items") > 0
    d = once(d, _r=folded(F.when(some, F.col("text")), F.col("_items")))
    d = d.withColumn("_new", F.when(some, F.col("_r.text")).otherwise(F.col("text")))
    d = d.withColumn("error", first_failure(F.col("text"), F.col("_new"), **options))
    return d.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ("text", items)),
        F.when(F.col("error").isNull(), F.col("_new")).otherwise(F.col("text")).alias("text"),
        F.col("_r.applied").cast("long").alias("replacements_applied"),
        F.col("_r.rejected").cast("long").alias("replacements_rejected"),
        "error",
        (F.size("_items") == 0).alias("skipped"),
    )


def all_matches(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, node_no, offset, length, find, replace, reason): every literal, non-overlapping occurrence of each item in each node."""
    p = plan.where(F.length("find") > 0).select(F.col("doc_id").alias("_id"), "find", "replace", "reason")
    hit = nodes.join(p, (nodes["doc_id"] == p["_id"]) & F.contains(nodes["text"], p["find"]))
    # Quoted for the pattern; a quote's end inside the text is quoted by itself.
    quoted = F.concat(F.lit("\\Q"), F.replace("find", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    gaps = F.transform(F.split("text", quoted, -1), lambda g: F.length(g))
    starts = F.aggregate(
        F.slice(gaps, 1, F.size(gaps) - 1),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda s, g: F.struct((s["at"] + g + F.length("find")).cast("int").alias("at"), F.concat(s["out"], F.array((s["at"] + g).cast("int"))).alias("out")),
        lambda s: s["out"],
    )
    return hit.select("doc_id", "node_no", F.explode(starts).alias("offset"), F.length("find").alias("length"), "find", "replace", "reason")


def keep_longest(matches: DataFrame) -> DataFrame:
    """(doc_id, node_no, kept, skipped): per node, in order of offset and then of length, those that start after the last one kept.

    A node's matches are bounded by its text.
    """
    m = F.struct("offset", (-F.col("length")).alias("neg"), "find", "replace", "reason", "length")
    rows = matches.groupBy("doc_id", "node_no").agg(F.array_sort(F.collect_list(m)).alias("all"))
    new = lambda x: F.struct(x["offset"].cast("int").alias("start"), (x["offset"] + x["length"]).cast("int").alias("end"), x["find"].alias("find"), x["replace"].alias("replace"), x["reason"].alias("reason"))
    kept = swept(F.transform("all", new), lambda x: x, "struct<start:int,end:int,find:string,replace:string,reason:string>")
    return rows.select("doc_id", "node_no", kept.alias("kept"), F.size("all").alias("_n")).withColumn("skipped", F.col("_n") - F.size("kept")).drop("_n")


def apply_matches(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """nodes with the new text, replacements_applied and length_delta."""
    k = kept.select(F.col("doc_id").alias("_id"), F.col("node_no").alias("_no"), "kept")
    j = nodes.join(k, (nodes["doc_id"] == k["_id"]) & (nodes["node_no"] == k["_no"]), "left").drop("_id", "_no")
    new = F.when(F.col("kept").isNull(), F.col("text")).otherwise(stitched(F.col("text"), F.col("kept"), lambda _, s: s["replace"]))
    j = j.withColumn("_new", new)
    return j.select(
        *(c for c in nodes.columns if c != "text"),
        F.col("_new").alias("text"),
        F.coalesce(F.size("kept"), F.lit(0)).alias("replacements_applied"),
        (F.length("_new") - F.length("text")).alias("length_delta"),
    )


def apply_report(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per document: replacements_applied, replacements_skipped_overlap, items_no_match, nodes_changed, length_delta, growth_ratio."""
    matches = all_matches(nodes, plan)
    kept = keep_longest(matches)
    edited = apply_matches(nodes, kept)
    changed = edited.groupBy("doc_id").agg(
        F.sum("replacements_applied").alias("replacements_applied"),
        F.sum(F.when(F.col("replacements_applied") > 0, 1).otherwise(0)).alias("nodes_changed"),
        F.sum("length_delta").alias("length_delta"),
        F.sum(F.length("text") - F.col("length_delta")).alias("_n"),
    )
    skipped = kept.groupBy("doc_id").agg(F.sum("skipped").alias("replacements_skipped_overlap"))
    missing = no_match(plan, matches).groupBy("doc_id").agg(F.count(F.lit(1)).alias("items_no_match"))
    r = changed.join(skipped, "doc_id", "left").join(missing, "doc_id", "left").fillna(0, ["replacements_skipped_overlap", "items_no_match"])
    return r.withColumn("growth_ratio", F.when(F.col("_n") > 0, F.col("length_delta") / F.col("_n")).otherwise(0.0)).drop("_n")


def no_match(plan: DataFrame, matches: DataFrame) -> DataFrame:
    """The plan items that match nowhere."""
    return plan.join(matches.select("doc_id", "find").distinct(), ["doc_id", "find"], "left_anti")


def apply_map(text: Column, items: Column) -> Column:
    """Every occurrence of each item's find text, item after item."""
    return F.aggregate(items, text, lambda t, i: F.when(F.length(i["find"]) > 0, F.replace(t, i["find"], i["replace"])).otherwise(t))


def automaton(finds: list[str]):
    """All find texts as one automaton with failure links; a hit's value is the places in the list that have this text."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, find in enumerate(finds):
        places.setdefault(find, []).append(k)
    out = ahocorasick.Automaton()
    for find, own in places.items():
        out.add_word(find, tuple(own))
    out.make_automaton()
    return out


def dictionary_hits(docs: DataFrame, dictionary: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(doc_id, item_no, find, replace, reason): the entries of one curated dictionary that occur in each document.

    Each text is read once, code point by code point, by an automaton of the entries,
    whatever their number. An automaton has `most` code points of entries (some 50 MB);
    the dictionary is summed first, and a larger one is cut by a hash of the entry into so many parts, each of which
    reads the texts once. No shuffle; every row of docs has each entry that occurs in it once.
    """
    entries = dictionary.where(F.length("find") > 0).select("item_no", "find", "replace", "reason")
    parts = -(-(entries.agg(F.sum(F.length("find"))).first()[0] or 0) // most)
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([texts.schema["doc_id"], *entries.schema.fields])
    passes = [_hits_of(texts, entries.where(F.pmod(F.xxhash64("find"), F.lit(parts)) == k) if parts > 1 else entries, schema) for k in range(max(1, parts))]
    return reduce(DataFrame.unionByName, passes)


def _hits_of(texts: DataFrame, part: DataFrame, schema: T.StructType) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(part.toArrow())  # of the size that dictionary_hits has checked

    def run(batches):
        entries, found = sent.value, None
        for b in batches:
            found = found or automaton(entries.column("find").to_pylist())
            at, hits = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                own = {place for _, places in found.iter(text) for place in places} if text and len(found) else ()
                at += [k] * len(own)
                hits += sorted(own)
            rows = entries.take(pa.array(hits, pa.int64())).combine_chunks()
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield from (pa.table([ids, *rows.columns], names=["doc_id", *rows.column_names]).cast(pa.schema([b.schema.field(0), *entries.schema])).to_batches() if at else ())

    return texts.mapInArrow(run, schema)


#: The category of a rule by a part of its name (fixed values of the rule engine), the first that fits.
RULE_CATEGORIES = [("MORFOLOGIK", "TYPOS"), ("SPELL", "TYPOS"), ("WHITESPACE", "SPACING"), ("SPAC", "SPACING"), ("COMMA", "PUNCTUATION"), ("PUNCT", "PUNCTUATION"), ("UPPERCASE", "CASING"), ("CASING", "CASING"), ("AGREEMENT", "SIMPLE_AGREEMENT")]


def rule_category(rule: Column, kind: Column | None = None) -> Column:
    """The safe category of a grammar rule by its name, else by the name of its kind; null for others, whose suggestions are not applied."""
    out = F.lit(None).cast("string")
    for name in [c for c in (kind, rule) if c is not None]:
        for part, category in reversed(RULE_CATEGORIES):
            out = F.when(F.upper(name).contains(part), category).otherwise(out)
    return out


def offset_suggestions(suggestions: DataFrame, category_map: DataFrame, safe: list[str]) -> DataFrame:
    """Suggestions whose rule's category is safe, with that category (the map is a small table of rule categories)."""
    return suggestions.join(category_map, "category").where(F.col("safe_category").isin(safe))


def apply_suggestions(docs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """docs with each (offset, length) replaced, overlapping later ones left out, and suggestions_applied."""
    nodes = docs.select("doc_id", F.lit(0).alias("node_no"), "text")
    text = docs.select("doc_id", "text")
    m = suggestions.join(text, "doc_id").select("doc_id", F.lit(0).alias("node_no"), "offset", "length", F.expr("substring(text, offset + 1, length)").alias("find"), F.col("replacement").alias("replace"), F.col("safe_category").alias("reason"))
    return apply_matches(nodes, keep_longest(m)).select("doc_id", "text", F.col("replacements_applied").alias("suggestions_applied"))


def masked_edits(matches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Matches that intersect a mask range (doc_id, start, end) of their document.

    A sweep: both are put in order of place within a document, and a match is hit if
    of the ranges that start before its end the one that reaches farthest ends behind its start. Sorting
    is all the work, whatever the number of matches and ranges; a window holds a document's own.
    """
    m = matches.where("doc_id is not null").select(F.struct("*").alias("_m"), F.col("doc_id").alias("_id"), (F.col("offset") + F.col("length")).alias("_at"), F.lit(0).alias("_kind"))
    r = ranges.where("doc_id is not null and start is not null").select(F.col("doc_id").alias("_id"), F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.col("end").alias("_end"))
    w = Window.partitionBy("_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept_rows = m.unionByName(r, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(w))
    return swept_rows.where(F.col("_m").isNotNull() & (F.col("_reach") > F.col("_m.offset"))).select("_m.*")


def lines(docs: DataFrame, text: str = "text", only: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, line_no, line): stripped lines that aren't blank, and for which `only` holds, from 0."""
    return docs.select("doc_id", F.posexplode(stripped_lines(F.col(text), only)).alias("line_no", "line"))


def stripped_lines(text: Column, only: Callable[[Column], Column] | None = None) -> Column:
    """array<string>: the stripped lines of a text that aren't blank, and for which `only` holds."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: (F.length(x) > 0) & only(x) if only else F.length(x) > 0)


def positions(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with their position and number in a group, and whether they are first or last."""
    w = Window.partitionBy(*key).orderBy(order)
    r = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return r.withColumn("is_first", F.col("pos") == 0).withColumn("is_last", F.col("pos") == F.col("n") - 1)
