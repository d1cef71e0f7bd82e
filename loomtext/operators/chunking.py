"""Documents to chunks: fixed width, sentence-packed, paragraph by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOT_BLANK = r"(?U)\S"
SENTENCE = r"(?s)(.+?(?:[.!?]+(?:\s+|\z)|\z))"
TEXTS = "cast(array() as array<string>)"


def fixed_width(text: Column, width: int = 600) -> Column:
    """array<string>: pieces of `width` code points; a null or empty text has none."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda k: F.substring(text, k * width + 1, F.lit(width)))).otherwise(F.expr(TEXTS))


def chunks(docs: DataFrame, width: int = 600, blank: bool = False) -> DataFrame:
    """(doc_id, chunk_no, start, end, text): the chunks that aren't blank, or with `blank` all; chunk_no counts all of them."""
    rows = docs.select("doc_id", F.posexplode(fixed_width(F.col("text"), width)).alias("chunk_no", "text"))
    rows = rows if blank else rows.where(F.col("text").rlike(NOT_BLANK))
    start = F.col("chunk_no") * width
    return rows.select("doc_id", "chunk_no", start.alias("start"), (start + F.length("text")).alias("end"), "text")


def sentences(text: Column) -> Column:
    """array<string>: sentences with the marks and the white space that end them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), 1)


def pack(parts: Column, most: int, overlap: int = 0) -> Column:
    """array<struct<text, start, end>>: parts joined in order while they stay within `most` code points.

    A part that is longer by itself stays whole. With `overlap`, a piece starts
    with the part before it, if that has at most so many code points and fits.
    """
    none = F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)")
    piece = lambda text, start, end: F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    def add(state: Column, part: Column) -> Column:
        n = F.length(part)
        end = state["at"] + n
        has = F.length(state["open"]) > 0
        full = has & (F.length(state["open"]) + n > most)
        short = (F.length(state["last"]) <= overlap) & (F.length(state["last"]) + n <= most) if overlap else F.lit(False)
        begin = F.when(short, F.concat(state["last"], part)).otherwise(part)
        return F.struct(
            end.cast("int").alias("at"),
            F.when(full, begin).otherwise(F.concat(state["open"], part)).alias("open"),
            F.when(full, end - F.length(begin)).otherwise(state["from"]).cast("int").alias("from"),
            part.alias("last"),
            F.when(full, F.concat(state["done"], F.array(piece(state["open"], state["from"], state["at"])))).otherwise(state["done"]).alias("done"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.lit(0).alias("from"), F.lit("").alias("last"), none.alias("done"))
    return F.aggregate(parts, start, add, lambda s: F.when(F.length(s["open"]) > 0, F.concat(s["done"], F.array(piece(s["open"], s["from"], s["at"])))).otherwise(s["done"]))


def sentence_chunks(text: Column, most: int = 600, overlap: int = 50) -> Column:
    """Sentences packed into chunks; a mask sentinel holds no sentence end and is never cut."""
    return pack(sentences(text), most, overlap)


def split_long(text: Column, most: int) -> Column:
    """array<string>, which joined is the text: sentences packed to `most`, longer ones at white space, longer words whole."""
    words = F.regexp_extract_all(text, F.lit(r"(?s)(\S+\s*|\s+)"), 1)
    parts = F.flatten(F.transform(sentences(text), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(r"(?s)(\S+\s*|\s+)"), 1))))
    short = F.length(text) <= most
    packed = F.transform(pack(F.when(F.size(words) > 0, parts).otherwise(F.array(text)), most), lambda p: p["text"])
    return F.when(short, F.array(text)).otherwise(packed)


def paragraphs(docs: DataFrame, most: int = 600) -> DataFrame:
    """(doc_id, chunk_no, type, text): code fences whole, other text as paragraphs packed to `most`."""
    fence = r"(?d)(?ms)(^```.*?^```[^\n]*(?:\n|\z)|(?:(?!^```).)+)"
    blocks = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(fence), 1)).alias("block_no", "block"))
    code = F.col("block").startswith("```")
    parts = F.regexp_extract_all("block", F.lit(r"(?s)(.+?(?:\n\n+|\z))"), 1)
    texts = F.when(code, F.array("block")).otherwise(F.transform(pack(parts, most), lambda p: p["text"]))
    rows = blocks.select("doc_id", "block_no", F.when(code, "code").otherwise("text").alias("type"), F.posexplode(texts).alias("part_no", "text")).where(F.col("text").rlike(NOT_BLANK))
    # Numbered within a document: its chunks only.
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no", "part_no")) - 1
    return rows.select("doc_id", number.alias("chunk_no"), "type", "text")


def skip_reason(text: Column, upper: float = 0.7, code: float = 0.5) -> Column:
    """Why a text node needs no look by a model: empty, url, mostly_uppercase, code_ish; null: it does."""
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))  # noqa: E731  # runs go at once, not sign by sign
    counts = F.struct(without("[^A-Za-z]+").alias("letters"), without("[^A-Z]+").alias("capitals"), without(r"\s+").alias("visible"))

    def reason(n: Column) -> Column:
        return F.when((n["letters"] > 0) & (n["capitals"] / n["letters"] > upper), "mostly_uppercase").when((n["visible"] - n["letters"]) / n["visible"] > code, "code_ish")

    # The counts are a variable of a one-element transformation, so that each is worked out once.
    return F.when(~text.rlike(NOT_BLANK), "empty").when(text.contains("//"), "url").otherwise(F.transform(F.array(counts), reason)[0])
