"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import forest, langid, lexical, media, mixing, piece, quality, sharding, simhash, spelling, substring, topk, toxicity
from loomtext.llm.base import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_toxic", "p_severe", "p_varied", F.col("rejected").alias("toxic"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Texts are read once; all that follows works on this narrow table.
    sizes = written(docs.select("doc_id", "source", mixing.words(docs["text"]).alias("n_words"), F.xxhash64("text").alias("tie")), "sizes")
    mixed = mixing.mix(sizes, size="n_words", tie="tie")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies", "rate")


def op9_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    found = langid.identify(table(spark, sf_dir, "documents"), remainder != 2)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.counted(table(spark, sf_dir, "documents")))


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(forest.vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_quality, op2_toxicity, op3_topk, op4_substring, op5_sharding, op6_simhash, op7_media, op8_mixing, op9_piece, op10_language, op11_spelling, op12_forest, op13_lexical]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": """
            WITH good AS (
                SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE)) AS v
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                GROUP BY vec_id
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
            ), ranked AS (
                SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
                FROM scored
            )
            SELECT * FROM ranked WHERE rank <= 5
        """,
        "op11_spelling": """
            WITH RECURSIVE crc_table AS (
                SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
            ), runs AS (
                SELECT doc_id, run, count(*) AS n
                FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
                WHERE length(run) >= 6
                GROUP BY ALL
            ), bytes AS (
                SELECT doc_id, run, n,
                    flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS b
                FROM runs
            ), hashed AS (
                SELECT run, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255)::BIGINT + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h
                FROM bytes, crc_table
            ), words AS (
                SELECT word, sum(n)::BIGINT AS n
                FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
                WHERE length(word) >= 6
                GROUP BY word HAVING sum(n) >= 5
            ), cut AS (
                SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
            ), near AS (
                SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
                UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
            ), best AS (
                SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
            ), forms AS (
                SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
                FROM words w LEFT JOIN best USING (word)
            ), follow AS (
                SELECT word, word AS root, 0 AS step FROM forms
                UNION ALL
                SELECT f.word, g.form, step + 1 FROM follow f JOIN forms g ON f.root = g.word WHERE g.form IS NOT NULL
            )
            SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word) USING (word)
        """,
        "op13_lexical": r"""
            WITH found AS (
                SELECT r, doc_id, term, count(*) AS tf
                FROM (
                    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                    FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
                )
                GROUP BY ALL
            ), docs AS (
                SELECT r, sum(tf)::BIGINT AS n FROM found GROUP BY r
            ), total AS (
                SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM docs
            ), asked AS (
                SELECT DISTINCT item_id, term
                FROM (
                    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                    FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)
                )
            ), weights AS (
                SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w
                FROM (SELECT term, count(*) AS df FROM found GROUP BY term), total
            ), scored AS (
                SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total.docs) // total.words))))::BIGINT AS score
                FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN docs USING (r), total
                GROUP BY item_id, r, doc_id
            ), ranked AS (
                SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
            )
            SELECT * FROM ranked WHERE rank <= 10
        """.replace("\\", "\\"[:1]),
    }
