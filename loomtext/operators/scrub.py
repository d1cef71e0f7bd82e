"""Boilerplate blocks: classification by content and by place in the document, removal, appendix."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.once import once

LINK = r"\[([^\]]*)\]\([^)]*\)"
NOTE = r"(?i)^\W*(?:a/n\b|author'?s? note|note from the author|translator'?s? note)"
NAVIGATION = r"(?i)\b(?:previous chapter|next chapter|table of contents|back to top|prev\b.*\bnext\b)"
PROMO = r"(?i)\b(?:patreon|ko-?fi|discord|subscribe|follow (?:me|us)|newsletter|support (?:me|us)|donate|licensed under|released under|all rights reserved|public license)\b"
#: What every text with a block of these kinds holds somewhere, beside links: the patterns without their bounds.
ANY = "|".join(p.replace(r"^\W*", "").replace(r"\b", "") for p in (NOTE, NAVIGATION, PROMO))
#: A part of each match of ANY in lower case; without an i, as that differs by the machine's language.
PARTS = ("a/n", "author", "translator", "chapter", "contents", "back to top", "prev", "patreon", "ko-f", "kof", "scord", "subscr", "follow ", "newsletter", "support ", "donate", "censed under", "released under", "ghts reserved", "publ")
CATEGORIES = ("authors_note", "navigation", "promo_ad_social", "link_farm")


def blocks(docs: DataFrame, separator: str = "\n\n+") -> DataFrame:
    """(doc_id, n_blocks, block_no, text)."""
    parts = F.split("text", separator, -1)
    return docs.select("doc_id", F.size(parts).alias("n_blocks"), F.posexplode(parts).alias("block_no", "text"))


def link_density(text: Column) -> Column:
    """Characters of link texts as a share of the block's."""
    shown = F.aggregate(F.regexp_extract_all(text, F.lit(LINK), 1), F.lit(0), lambda n, t: n + F.length(t))
    return F.when(F.length(text) > 0, shown / F.length(text)).otherwise(0.0)


def category(text: Column, farm: float = 0.5, least: int = 12) -> Column:
    """The kind of boilerplate a block is, or null; shorter blocks are none."""
    return F.when(F.length(text) < least, F.lit(None)).when(text.rlike(NOTE), "authors_note").when(text.rlike(NAVIGATION), "navigation").when(text.rlike(PROMO), "promo_ad_social").when(link_density(text) > farm, "link_farm")


def candidates(parts: DataFrame, edge: float = 0.3, switches: tuple[str, ...] = CATEGORIES, kept_headings: tuple[str, ...] = ()) -> DataFrame:
    """Blocks with category, position (edge_top, edge_bottom, middle), reason and removed; only blocks at the edges are removed. Map-only."""
    p = parts.withColumn("category", category(F.col("text"))).withColumn("position", position(F.col("block_no"), F.col("n_blocks"), edge))
    p = p.withColumn("reason", reason(F.col("text"), F.col("category"), F.col("position"), switches, kept_headings))
    return p.withColumn("removed", F.coalesce(~F.col("reason").startswith("kept_"), F.lit(False)))


def position(number: Column, n: Column, edge: float) -> Column:
    return F.when(number < n * edge, "edge_top").when(number >= n * (1 - edge), "edge_bottom").otherwise("middle")


def reason(text: Column, kind: Column, place: Column, switches: tuple[str, ...], kept_headings: tuple[str, ...]) -> Column:
    """Why a block of boilerplate goes, or (kept_...) stays; null for other blocks."""
    heading = F.lit(False)
    for h in kept_headings:
        heading = heading | text.startswith(h)
    return (
        F.when(kind.isNull(), F.lit(None))
        .when(heading, "kept_whitelisted")
        .when(~kind.isin(list(switches)), "kept_switched_off")
        .when(place == "middle", "kept_middle_bias")
        .when(kind == "link_farm", "Link density")
        .otherwise(kind)
    )


def scrub(docs: DataFrame, separator: str = "\n\n+", joiner: str = "\n\n", edge: float = 0.3, switches: tuple[str, ...] = CATEGORIES, kept_headings: tuple[str, ...] = ()) -> DataFrame:
    """docs with the text of the blocks that stay, and `removed`, the number of the others: candidates and scrubbed within a row, without a shuffle.

    Blocks are judged one by one only in texts that hold a link or the words of any kind; plain parts
    of the words are looked for first.
    """

    def judged(parts: Column) -> Column:
        block = lambda b, k: F.struct(b.alias("text"), category(b).alias("kind"), position(k, F.size(parts), edge).alias("place"))
        gone = lambda x: F.coalesce(~reason(x["text"], x["kind"], x["place"], switches, kept_headings).startswith("kept_"), F.lit(False))
        return F.transform(F.transform(parts, block), lambda x: F.when(~gone(x), x["text"]))

    parts = F.split("text", separator, -1)
    part = F.exists(F.array(F.lower("text")), lambda v: reduce(or_, (v.contains(p) for p in PARTS)))
    suspect = F.col("text").contains("](") | (part & F.col("text").rlike(ANY))
    d = once(docs, _kept=F.when(suspect, F.transform(F.array(parts), judged)[0]).otherwise(parts))
    text = F.regexp_replace(F.array_join("_kept", joiner), "\n{4,}", "\n\n\n")  # nulls are left out
    gone = F.size(F.filter("_kept", lambda x: x.isNull()))
    return d.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed"), gone.cast("long").alias("removed"))


def scrubbed(parts: DataFrame, joiner: str = "\n\n", dry_run: bool = False) -> DataFrame:
    """(doc_id, text, removed): each document of its blocks that stay; in a dry run of all."""
    stays = F.when(~F.col("removed") | F.lit(dry_run), F.struct("block_no", "text"))
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(stays)).alias("b"), F.sum(F.col("removed").cast("long")).alias("removed"))
    text = F.array_join(F.transform("b", lambda x: x["text"]), joiner)
    return rows.select("doc_id", F.regexp_replace(text, "\n{4,}", "\n\n\n").alias("text"), "removed")


def appendix(parts: DataFrame) -> DataFrame:
    """The removed blocks by category."""
    return parts.where("removed").select("category", "doc_id", "block_no", "position", "text")
