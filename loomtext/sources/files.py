"""Reading and writing corpora, plans, reports, lexicons and run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLAN = "find string, replace string, reason string"
REPORT = (
    "source string, created_at string, "
    "chunks array<struct<id:int,range:struct<start_byte:int,end_byte:int>,replacements:array<struct<find:string,replace:string,reason:string>>>>, "
    "summary struct<unique_problem_words:array<string>,replacement_map:map<string,string>>"
)
RUN = "timestamp string, variant string, similarity double, suggestions_valid int, suggestions_rejected int, plan_size int, replacements_applied int, replacements_rejected int, validation_passed boolean, error string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one document for each text file; its id is a hash of its path."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return d.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def write_documents(df: DataFrame, path: str, by: list[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_texts(df: DataFrame, path: str) -> None:
    df.select("text").write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, step string, key string, value long").json(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(path, item_no, find, replace, reason) of JSON files that each hold one array of items, in the array's order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"array<struct<{PLAN.replace(' string', ':string')}>>").alias("items"))
    rows = whole.select("path", F.posexplode("items").alias("item_no", "i"))
    return rows.select("path", "item_no", "i.find", "i.replace", F.coalesce("i.reason", F.lit("unknown")).alias("reason"))


def read_prompts(spark: SparkSession, path: str | None, default: dict[str, str]) -> DataFrame:
    """(key, prompt): a JSON object's prompts over the defaults; without a path the defaults."""
    base = spark.createDataFrame(list(default.items()), "key string, prompt string")
    if path is None:
        return base
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "prompt"))
    return base.join(own.select("key"), "key", "left_anti").unionByName(own)


def read_lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(word, kind): one word for each line that isn't blank."""
    word = F.trim("value")
    return spark.read.text(path).select(word.alias("word"), F.lit(kind).alias("kind")).where(F.length("word") > 0)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_no, ts, variant, similarity, ...): the results of run histories, numbered through all files in the order of their paths; time stamps of both shapes.

    One task numbers the runs: they are experiments, a row each.
    """
    item = f"struct<{', '.join(f.replace(' ', ':', 1) for f in RUN.split(', '))}>"
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"struct<results:array<{item}>>").alias("h"))
    rows = whole.select("path", F.posexplode("h.results").alias("pos", "r"))
    rows = rows.select((F.row_number().over(Window.orderBy("path", "pos")) - 1).alias("run_no"), "r.*")
    ts = F.coalesce(F.try_to_timestamp("timestamp", F.lit("yyyyMMdd_HHmmss")), F.try_to_timestamp("timestamp"))
    return rows.withColumn("ts", ts).drop("timestamp")


def report(chunks: DataFrame, items: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, report): per document, the prepass report as JSON from chunks (doc_id, source, chunk_no, start_byte, end_byte) and items (doc_id, chunk_no, item_no, find, replace, reason).

    Unique words are in order of first place; of repeated words the last replacement counts.
    """
    item = F.struct("item_no", "find", "replace", "reason")
    own = items.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(item)).alias("r"))
    place = F.struct("chunk_no", "item_no")
    words = items.groupBy("doc_id", "find").agg(F.min(place).alias("at"), F.max_by("replace", place).alias("replace"))
    summary = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "find", "replace"))).alias("w"))
    c = chunks.join(own, ["doc_id", "chunk_no"], "left")
    plain = F.coalesce(F.transform("r", lambda x: F.struct(x["find"].alias("find"), x["replace"].alias("replace"), x["reason"].alias("reason"))), F.expr("cast(array() as array<struct<find:string,replace:string,reason:string>>)"))
    chunk = F.struct(F.col("chunk_no").alias("id"), F.struct("start_byte", "end_byte").alias("range"), plain.alias("replacements"))
    rows = c.groupBy("doc_id", source).agg(F.array_sort(F.collect_list(chunk)).alias("chunks")).join(summary, "doc_id", "left")
    found = F.coalesce("w", F.expr("cast(array() as array<struct<at:struct<chunk_no:int,item_no:int>,find:string,replace:string>>)"))
    said = F.struct(F.transform(found, lambda x: x["find"]).alias("unique_problem_words"), F.map_from_entries(F.transform(found, lambda x: F.struct(x["find"], x["replace"]))).alias("replacement_map"))
    return rows.select("doc_id", F.to_json(F.struct(F.col(source).alias("source"), F.lit(None).cast("string").alias("created_at"), "chunks", said.alias("summary"))).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports (doc_id, report) as files of one JSON object for each line, with the document's id beside it."""
    reports.select(F.to_json(F.struct("doc_id", parsed_report(F.col("report")).alias("report"))).alias("value")).write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, report as a struct) of files from write_reports."""
    row = "doc_id long, report struct<" + REPORT.replace(" string", ":string", 2).replace("chunks array", "chunks:array").replace("summary struct", "summary:struct") + ">"
    return spark.read.schema(row).json(path)


def parsed_report(report: Column) -> Column:
    """A report's JSON as a struct."""
    return F.from_json(report, REPORT)
