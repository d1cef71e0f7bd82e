"""From documents to find/replace plans: rules, checks, budgets, duplicates, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLAN = ["doc_id", "item_no", "find", "replace", "reason"]

#: (rule, reason, pattern with the find text as group 1). (?U): words and their ends by Unicode, whatever the Java version.
RULES = [
    ("punct_runs", "SIMPLE_PUNCT", r"([!?]{2,})"),
    ("caps", "CASE_GLITCH", r"(?<![\p{L}\p{N}_])([A-Z]{4,})(?![\p{L}\p{N}_])"),
    ("spaced_letters", "TTS_SPACED", r"(?U)(\b\p{L}(?: \p{L}){3,}\b)"),
    ("hyphen_letters", "TTS_SPACED", r"(?U)(\b[A-Za-z](?:-[A-Za-z]){3,}\b)"),
    ("sound_effect", "TTS_SPACED", r"(\*[A-Z]+!*\*)"),
    ("laugh", "SIMPLE_PUNCT", r"(?Ui)\b((?:ha){3,}h?|(?:he){3,}h?)\b"),
    ("scream", "CASE_GLITCH", r"(?Ui)\b(\w*([a-z])\2{3,}\w*)\b"),
    ("speaker", "SIMPLE_PUNCT", r"(\[[A-Z][A-Za-z]*\]:)"),
    ("small_caps", "UNICODE_STYLIZED", "([ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ]{2,})"),
    ("nested_parens", "SIMPLE_PUNCT", r"(\({2,}|\){2,})"),
]
#: Small capitals and their letters (fixed values).
SMALL_CAPS = ("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz")


def _replacement(rule: str, find: Column) -> Column:
    if rule in ("punct_runs", "nested_parens"):
        return F.substring(find, 1, 1)
    if rule == "caps":
        return F.lower(find)
    if rule in ("spaced_letters", "hyphen_letters"):
        return F.initcap(F.lower(F.regexp_replace(find, "[ -]", "")))
    if rule == "sound_effect":
        return F.initcap(F.lower(F.regexp_replace(find, "[*!]", "")))
    if rule == "laugh":
        return F.substring(find, 1, 4)
    if rule == "scream":
        return F.regexp_replace(find, r"(?i)([a-z])\1{3,}", "$1")
    if rule == "speaker":
        return F.regexp_replace(find, r"[\[\]]", "")
    return F.translate(find, *SMALL_CAPS)


def found_items(text: Column, rules: list[str] | None = None) -> Column:
    """array<struct>: what each rule finds in a text, in order of rules and of place; items that change nothing included."""

    def found(number: int, rule: str, reason: str, pattern: str) -> Column:
        item = lambda h, k: F.struct(F.lit(number).alias("rule_no"), k.alias("k"), F.lit(rule).alias("rule"), h.alias("find"), _replacement(rule, h).alias("replace"), F.lit(reason).alias("reason"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), item)

    return F.array_sort(F.concat(*(found(number, *r) for number, r in enumerate(RULES) if rules is None or r[0] in rules)))


def own_plan(text: Column, rules: list[str] | None = None) -> Column:
    """A text's own plan as an array for apply_items: the same items and numbers as detect gives."""
    items = F.transform(found_items(text, rules), lambda i, k: F.struct(k.alias("item_no"), i["find"].alias("find"), i["replace"].alias("replace")))
    return F.filter(items, lambda i: ~i["find"].eqNullSafe(i["replace"]))


def detect(texts: DataFrame, key: list[str], rules: list[str] | None = None) -> DataFrame:
    """key columns, rule, item_no, find, replace, reason: what each rule finds in each text, in order of place within a rule."""
    items = texts.select(*key, F.posexplode(found_items(F.col("text"), rules)).alias("item_no", "i"))
    return items.select(*key, "item_no", "i.rule", "i.find", "i.replace", "i.reason").where(~F.col("find").eqNullSafe(F.col("replace")))


def known_in_text(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """plan with `valid`: its find text occurs in the whole document (an empty one always does)."""
    d = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"))
    return plan.join(d, plan["doc_id"] == d["_id"], "left").withColumn("valid", F.coalesce(F.contains("_text", "find"), F.lit(False))).drop("_id", "_text")


def item_error(allowed: list[str] | None = None, blocked: list[str] = (), most: int = 80, growth: int = 10) -> Column:
    """The reject code of a plan item, or null."""
    find, new, why = F.col("find"), F.col("replace"), F.col("reason")
    schema = find.isNull() | new.isNull() | why.isNull() | (F.length(find) == 0) | (F.length(find) > most) | find.contains("\n")
    if allowed is not None:
        schema = schema | ~why.isin(allowed)
    if blocked:
        schema = schema | why.isin(list(blocked))
    return (
        F.when(schema, "schema")
        .when(new.rlike(r"[`*_\[\]()<>~]"), "forbidden_chars")
        .when(F.length(new) - F.length(find) > growth, "length_delta")
    )


def within_budget(plan: DataFrame, span: list[str], length: str, most: int = 16, share: float = 0.05) -> DataFrame:
    """plan with `rejection`: duplicate, budget, or length_delta for all of a span whose total change is over its share; null: kept.

    A span's items are few (a model's answer), so that one window holds a span.
    """
    first = Window.partitionBy(*span, "find", "replace").orderBy("item_no")
    order = Window.partitionBy(*span).orderBy("item_no")
    p = plan.withColumn("_dup", F.row_number().over(first) > 1)
    p = p.withColumn("_n", F.sum(F.when(F.col("_dup"), 0).otherwise(1)).over(order))
    kept = ~F.col("_dup") & (F.col("_n") <= most)
    delta = F.sum(F.when(kept, F.length("replace") - F.length("find")).otherwise(0)).over(Window.partitionBy(*span))
    p = p.withColumn("_delta", delta)
    why = F.when(F.col("_dup"), "duplicate").when(F.col("_n") > most, "budget").when(F.col("_delta") > share * F.col(length), "length_delta")
    return p.withColumn("rejection", why).drop("_dup", "_n", "_delta")


def first_of_each(plan: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (doc_id, find, replace): the first in `order`."""
    return plan.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "find", "replace").orderBy(*order))).where("_n = 1").drop("_n")


def merged(plans: list[DataFrame]) -> DataFrame:
    """The union of plans (doc_id, find, replace, reason) without repeated pairs; earlier plans win."""
    rows = None
    for k, plan in enumerate(plans):
        own = plan.select("doc_id", F.lit(k).alias("plan_no"), "item_no", "find", "replace", "reason")
        rows = own if rows is None else rows.unionByName(own)
    return first_of_each(rows, ["plan_no", "item_no"])


def same_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The (doc_id, find, replace) that only one of two plans has; no row: the order of detection didn't matter."""
    cols = ["doc_id", "find", "replace"]
    x, y = a.select(*cols).distinct(), b.select(*cols).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def problem_words(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """group, find, first position, and the last replacement in order."""
    place = F.struct(*order)
    return items.groupBy(*group, "find").agg(F.min(place).alias("first_at"), F.max_by("replace", place).alias("replace"), F.count(F.lit(1)).alias("n"))


def problem_topk(items: DataFrame, folder: str, k: int = 10, buckets: int = 1 << 14) -> DataFrame:
    """reason, find, n, docs, rank: the most frequent problems of each reason over the corpus, ties to the smaller text. Exact.

    Texts are hashed into `buckets`, and each (reason, bucket) is counted: a
    bucket's count is no less than that of any text in it. The texts of each
    reason's 2 k fullest buckets are then counted by themselves; their k-th count
    is a floor (0 if they are fewer than k), which no true top-k text is below, so
    that only buckets whose count reaches the floor can hold one. Only items of
    these are grouped by text and document. The narrow items and the buckets'
    counts are written to `folder`, as they are read several times.
    """
    spark = items.sparkSession
    bucket = F.pmod(F.xxhash64("find"), F.lit(buckets)).cast("int")
    items.select("reason", "find", "doc_id", bucket.alias("bucket")).write.parquet(f"{folder}/items")
    narrow = spark.read.parquet(f"{folder}/items")
    narrow.groupBy("reason", "bucket").agg(F.count(F.lit(1)).alias("held")).write.parquet(f"{folder}/buckets")
    held = spark.read.parquet(f"{folder}/buckets")

    def of_buckets(chosen: DataFrame) -> DataFrame:
        c = chosen.select(F.col("reason").alias("_reason"), F.col("bucket").alias("_bucket"))
        return narrow.join(c, F.col("reason").eqNullSafe(F.col("_reason")) & (F.col("bucket") == F.col("_bucket")), "left_semi")

    fullest = held.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("held"), "bucket"))).where(F.col("_r") <= 2 * k)
    sample = of_buckets(fullest).groupBy("reason", "find").agg(F.count(F.lit(1)).alias("n"))
    sample = sample.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "find"))).where(F.col("_r") <= k)
    floors = sample.where(F.col("_r") == k).select(F.col("reason").alias("_of"), F.col("n").alias("floor"))
    reach = held.join(floors, F.col("reason").eqNullSafe(F.col("_of")), "left").where(F.col("held") >= F.coalesce("floor", F.lit(0)))
    counts = of_buckets(reach).groupBy("reason", "find", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("reason", "find").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "find"))).where(F.col("rank") <= k)
