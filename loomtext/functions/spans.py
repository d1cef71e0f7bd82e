"""Protected spans of Markdown: finding, masking, unmasking, text nodes and re-stitching, as Column expressions.

Each pattern scans a text on its own: the gaps between its matches (split) and
the matches (regexp_extract_all) give the offsets, in code points, as running
sums. Spans that overlap an earlier kept one are dropped, in order of start and
then of pattern. A pattern is tried only on texts that hold a sign which each of its
matches has. Time is linear in a text and its spans, or nearly so: folds and cuts go in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.once import BLOCK, blocks, collected

#: (type, pattern with the whole match as group 1, prefix pattern whose length precedes the protected part, or None).
#: Fixed values of the format. (?d): only a line feed ends a line.
PATTERNS = [
    ("CODE_FENCE", r"(?d)(?ms)(^```[a-zA-Z]*\n.*?^```\s*$|^~~~[a-zA-Z]*\n.*?^~~~\s*$)", None),
    ("INLINE_CODE", r"(`+[^`]+`+)", None),
    ("LINK_URL", r"(\[[^\]]+\]\([^)]+\))", r"^\[[^\]]+\]\("),
    ("IMAGE_URL", r"(!\[[^\]]*\]\([^)]+\))", r"^!\[[^\]]*\]\("),
    ("HTML_BLOCK", r"(?si)(<(details|div|table|script|style).*?</\2>)", None),
    ("MATH_BLOCK", r"(?s)(\$\$.+?\$\$)", None),
    ("INLINE_MATH", r"((?<!\\)\$[^$]+(?<!\\)\$)", None),
]
#: More kinds, off by default.
EXTRA = [("AUTOLINK", r"(<https?://[^>\s]+>)", None), ("FRONT_MATTER", r"(?d)(?s)(\A---\n.*?\n---\n)", None)]

#: What a text has that holds a match.
SIGNS = {"CODE_FENCE": ("```", "~~~"), "INLINE_CODE": ("`",), "LINK_URL": ("](",), "IMAGE_URL": ("![",), "HTML_BLOCK": ("</",), "MATH_BLOCK": ("$$",), "INLINE_MATH": ("$",), "AUTOLINK": ("<http",), "FRONT_MATTER": ("---",)}
SPAN = "struct<start:int,end:int,type:string,text:string>"
FOUND = "struct<start:int,ord:int,end:int,type:string,text:string>"


def _found(text: Column, kind: str, pattern: str, prefix: str | None, order: int) -> Column:
    """Every match of one pattern. Each match is paired with the gap before it, so that both are found once."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 1)
    pairs = F.filter(F.zip_with(hits, F.split(text, pattern, -1), lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap"))), lambda x: x["hit"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = (at + x["gap"]).cast("int")
        return (begin + F.length(x["hit"])).cast("int"), F.array(begin)

    def span(x: Column, begin: Column) -> Column:
        # Of a link or image only the target is protected; the closing bracket isn't.
        lead = F.length(F.regexp_extract(x["hit"], prefix, 0)) if prefix else F.lit(0)
        size = F.length(x["hit"]) - lead - (1 if prefix else 0)
        return F.struct(
            (begin + lead).cast("int").alias("start"),
            F.lit(order).alias("ord"),
            (begin + lead + size).cast("int").alias("end"),
            F.lit(kind).alias("type"),
            F.substring(x["hit"], lead + 1, size).alias("text"),
        )

    # The fold gives out numbers only, as what it has given out is copied.
    whole = F.transform(F.array(pairs), lambda own: F.zip_with(own, collected(own, F.lit(0), step, "int"), span))[0]
    there = F.lit(False)
    for sign in SIGNS[kind]:
        there = there | text.contains(sign)
    return F.when(there, whole).when(text.isNotNull(), F.expr(f"cast(array() as array<{FOUND}>)"))


def spans(text: Column, extra: bool = False) -> Column:
    """array<struct<start, end, type, text>>: the kept spans in order."""
    patterns = PATTERNS + (EXTRA if extra else [])
    found = [_found(text, kind, pattern, prefix, k) for k, (kind, pattern, prefix) in enumerate(patterns)]
    return keep_first(F.array_sort(F.concat(*found)))


def swept(ordered: Column, make: Callable[[Column], Column], kind: str) -> Column:
    """array<kind>: of elements in order of `start`, what `make` makes of those that start at or after the `end` of the last one kept."""

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["end"]).otherwise(end).cast("int"), F.array(free)

    def kept(own: Column) -> Column:
        free = F.transform(F.array(collected(own, F.lit(0), step, "boolean")), lambda free: F.filter(own, lambda x, k: free[k]))[0]
        # Mostly none starts before the one before it ends; without a fold that is seen at once.
        apart = ~F.exists(F.transform(own, lambda x, k: x["start"] < F.when(k > 0, F.element_at(own, F.greatest(k, F.lit(1)))["end"]).otherwise(0)), lambda late: late)
        return F.transform(F.when(apart, own).otherwise(free), make)

    return F.transform(F.array(ordered), lambda own: F.when(F.size(own) > 0, kept(own)).when(own.isNotNull(), F.expr(f"cast(array() as array<{kind}>)")))[0]


def keep_first(ordered: Column) -> Column:
    """Of spans in order, those that start at or after the end of the last one kept."""
    return swept(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text")), SPAN)


def sentinel(n: Column) -> Column:
    return F.concat(F.lit("__MASKED_"), n.cast("string"), F.lit("__"))


def gaps(text: Column, found: Column) -> Column:
    """array<string>: the texts before, between and after the spans, one more than there are spans.

    A place in a text is found by counting from its start, so that the text is cut
    into the stretch of each block of spans first.
    """

    def cut(v: Column) -> Column:
        start = lambda k: F.when(k > 0, F.element_at(v["own"], F.greatest(k, F.lit(1)))["end"]).otherwise(v["from"])
        return F.transform(v["own"], lambda s, k: F.substring(v["stretch"], start(k) - v["from"] + 1, s["start"] - start(k)))

    def stretch(spans: Column, own: Column, b: Column) -> Column:
        start = before(spans, b * BLOCK)
        end = F.when(F.size(own) > 0, F.element_at(own, F.greatest(F.size(own), F.lit(1)))["end"]).otherwise(start)
        return F.struct(own.alias("own"), start.cast("int").alias("from"), F.substring(text, start + 1, end - start).alias("stretch"))

    def all_of(spans: Column) -> Column:
        parts = F.transform(blocks(spans), lambda own, b: F.transform(F.array(stretch(spans, own, b)), cut)[0])
        return F.concat(F.flatten(parts), F.array(F.substring(text, before(spans, F.size(spans)) + 1, F.length(text))))

    return F.transform(F.array(found), all_of)[0]


def stitched(text: Column, found: Column, part: Callable[[Column, Column], Column]) -> Column:
    """The text with span n replaced by part(n, span): gaps and parts as an array, joined once."""

    def pieces(v: Column) -> Column:
        each = F.transform(v["spans"], lambda s, k: F.concat(v["gaps"][k], part(k, s)))
        return F.array_join(F.concat(each, F.slice(v["gaps"], -1, 1)), "")

    # Spans are worked out once, as a variable of this one-element transformation.
    joined = F.transform(F.transform(F.array(found), lambda s: F.struct(s.alias("spans"), gaps(text, s).alias("gaps"))), pieces)[0]
    return F.when(F.size(found) == 0, text).otherwise(joined)


def before(spans: Column, k: Column) -> Column:
    """Where the span before span k ends."""
    return F.when((k > 0) & (F.size(spans) > 0), F.element_at(spans, F.greatest(F.least(k.cast("int"), F.size(spans)), F.lit(1)))["end"]).otherwise(0)


def masked(text: Column, found: Column) -> Column:
    return stitched(text, found, lambda k, _: sentinel(k))


def mask_table(found: Column) -> Column:
    """map<sentinel, original> of the kept spans."""
    return F.map_from_entries(F.transform(found, lambda s, k: F.struct(sentinel(k), s["text"])))


def unmasked(text: Column, table: Column) -> Column:
    """Every sentinel replaced by its original, longest sentinels first.

    Where no original can make a new sentinel, this is one pass over the text; else one for each of them.
    """
    entries = F.transform(F.map_entries(table), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    one_by_one = F.aggregate(F.array_sort(entries), text, lambda t, e: F.replace(t, e["key"], e["value"]))
    return F.when(F.size(table) == 0, text).otherwise(F.when(_independent(text, table), _in_one_pass(text, table)).otherwise(one_by_one))


def _independent(text: Column, table: Column) -> Column:
    """The table's sentinels are numbered in order, the text has no other trace of one, and the originals have none."""
    numbered = F.map_keys(table) == F.transform(F.sequence(F.lit(0), F.size(table) - 1), sentinel)
    whole = F.regexp_count(text, F.lit("MASKED")) == F.regexp_count(text, F.lit(r"__MASKED_\d{1,9}__"))
    apart = ~text.rlike(r"__MASKED_\d+__MASKED_")
    return numbered & whole & apart & ~F.exists(F.map_values(table), lambda v: v.contains("MASKED"))


def _in_one_pass(text: Column, table: Column) -> Column:
    def pieces(v: Column) -> Column:
        back = lambda n: F.when(n.cast("int") < F.size(v["values"]), v["values"][n.cast("int")]).otherwise(F.concat(F.lit("__MASKED_"), n, F.lit("__")))
        return F.array_join(F.concat(F.transform(v["numbers"], lambda n, k: F.concat(v["gaps"][k], back(n))), F.slice(v["gaps"], -1, 1)), "")

    parts = F.struct(F.regexp_extract_all(text, F.lit(r"__MASKED_(\d+)__"), 1).alias("numbers"), F.split(text, r"__MASKED_\d+__", -1).alias("gaps"), F.map_values(table).alias("values"))
    return F.transform(F.array(parts), pieces)[0]


def text_nodes(text: Column, found: Column) -> Column:
    """The gaps between the spans as array<struct<start, end, text>>, without blank ones."""

    def nodes(v: Column) -> Column:
        start = lambda k: before(v["spans"], k).cast("int")
        last = F.length(text).cast("int")
        each = F.transform(v["spans"], lambda s, k: F.struct(start(k).alias("start"), s["start"].cast("int").alias("end"), v["gaps"][k].alias("text")))
        return F.concat(each, F.array(F.struct(start(F.size(v["spans"])).alias("start"), last.alias("end"), F.element_at(v["gaps"], -1).alias("text"))))

    both = F.transform(F.array(found), lambda s: F.struct(s.alias("spans"), gaps(text, s).alias("gaps")))
    return F.filter(F.transform(both, nodes)[0], lambda n: n["text"].rlike(r"(?U)\S"))


def outside(text: Column, found: Column, change: Callable[[Column], Column]) -> Column:
    """The text with `change` applied to its text nodes only (blank ones stay)."""
    nodes = text_nodes(text, found)
    return stitched(text, nodes, lambda _, s: change(s["text"]))
