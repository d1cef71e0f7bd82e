"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents.

1. toxicity: documents that the classifier chain rejects go.
2. simhash: one row of each near-duplicate group stays. Texts are near
   duplicates from a Jaccard similarity of 0.8 of their 5-word shingles on.
3. substring: repeated passages are cut out of the texts.
4. mixing: every source's words are brought to its target; a document comes as often as its copies say.
5. sentencepiece: what is left is encoded.

Stage 2 decides by row: rows of one doc_id with different texts, and rows without
a doc_id, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import mixing, nearcopies, piece, substring, toxicity
from loomtext.llm.base import written
from loomtext.llm.queries import table, vocabulary

#: SQL can't express the trained chain, the fingerprints or the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("not rejected").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece.encode_documents(docs, vocabulary(), kept=40_000, release=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring", cut_repeats), ("mixing", mix_sources), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
