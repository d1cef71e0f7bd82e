"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

Main path in DataFrame functions only. Every child c of a tree node draws
``-ln(u) / weight(c)`` where u is a hash of the document's key and c's name;
the smallest draw wins. Draws of other children do not depend on c, so that a
changed weight moves documents only into or out of that child's subtree, and
inside the subtree only below the nodes whose weights changed too.

A grown tree gets its new shard as a region of its own: no other weight
changes, so rows move only into the new shard.

Defined cases: null text has size 1 and CRC 0 (that of no bytes); a null key
hashes like the text ``null``; rows that repeat a key share its shard and get
slots of their own; an empty table gives an empty result; only the named
columns of the input are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int = 16, regions: int = 4, racks: int = 2) -> list[Leaf]:
    return [Leaf(f"r{i * regions // shards}", f"k{i * regions * racks // shards % racks}", i) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region."""
    shard = max(x.shard for x in tree) + 1
    return [*tree, Leaf(f"new{shard}", "k0", shard, weight)]


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw: 52 bits of a hash as a uniform number in (0, 1), then -ln(u) / weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def pick(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the smallest draw; one option needs none."""
    if len(options) == 1:
        return options[0][2]
    return F.array_min(F.array(*(F.struct(draw(key, name, w).alias("d"), value.alias("v")) for name, w, value in options)))["v"]


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key. A level is drawn only within the subtree that the level above chose."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    mass = lambda leaves: float(sum(x.weight for x in leaves))

    def within(region: str) -> Column:
        racks = regions[region]
        chosen = pick(key, [(f"{region}/{k}", mass(v), F.lit(k)) for k, v in racks.items()])
        out = None
        for k, leaves in racks.items():
            shard = pick(key, [(f"{region}/{k}/{x.shard}", x.weight, F.lit(x.shard)) for x in leaves])
            out = F.when(chosen == k, shard) if out is None else out.when(chosen == k, shard)
        return out

    chosen = pick(key, [(r, mass([x for v in k.values() for x in v]), F.lit(r)) for r, k in regions.items()])
    out = None
    for r in regions:
        out = F.when(chosen == r, within(r)) if out is None else out.when(chosen == r, within(r))
    return out


def assign(df: DataFrame, key: str, tree: list[Leaf], out: str = "shard") -> DataFrame:
    return df.withColumn(out, descend(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree).cast("int"))


def with_slots(df: DataFrame, group: str, order: list[Column], spread: Column, parts: int) -> DataFrame:
    """Gapless numbers from 0 in every group, without sorting a whole group in one task.

    Every group is cut into `parts` pieces by `spread`; the pieces' counts (at
    most groups * parts rows) give each piece its first number.
    """
    cut = df.withColumn("_piece", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    counts = cut.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = cut.withColumn("_row", F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order)))
    return (
        numbered.join(F.broadcast(first), [group, "_piece"])  # at most groups * parts rows
        .withColumn("slot", (F.col("_first") + F.col("_row") - 1).cast("long"))
        .drop("_piece", "_first", "_row")
    )


def shard_documents(docs: DataFrame, tree: list[Leaf] | None = None, parts: int = 512) -> DataFrame:
    """Every document's shard, its shard in the grown tree, and a slot in its shard."""
    tree = tree or balanced_tree()
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(base, "doc_id", tree), "doc_id", grown(tree), "grown_shard")
    # By text too, so that rows of one doc_id (all null ones among them) share no piece unless their texts are equal.
    own = [F.col(c) for c in ("doc_id", "text_crc32", "size")]
    out = with_slots(placed, "shard", own, F.struct(*own), parts)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


