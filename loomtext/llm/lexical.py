"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to `stages` owners, rare terms to the first and
the commonest to the last, so that owners hold about as many postings each. An
item's bundle, with its accumulators (document, score so far), visits one owner
after the other: a cogroup of the bundles with that owner's postings, which adds
their integer contributions. Documents are cut into slices of about `slice_size`
and items into chunks of about `chunk_terms` terms; there is a bundle for each item
and slice, and a task's group is one slice and chunk, whatever the size of the corpus.

Accumulators stay sparse without loss. A bundle's k-th best score so far is a
floor for its slice; the largest contribution of each term over all documents is
known. After a stage those documents go whose score and all that later owners can
add stay below the floor, and a document that no bundle holds yet isn't taken up
where that is so for it. At last each bundle gives its k best, and a window ranks these.

Texts are read once. Which of a document's terms are an item's is first asked of a
bitmap of fixed size (`FILTER_BITS`) of hashed terms, which alone is broadcast; an
equi-join on the term decides.

Score: w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and
w * ((10^9 tf) div (1000 tf + 8 m)) for each distinct term of the item.

Defined cases: ids are longs. Null texts have no term; a document without a term
is none of the N. Rows that repeat a doc_id are separate documents. Rows that
repeat an item_id are one item, with the smallest text; null is an id like any
other. Equal scores by doc_id, null last. Items without a term, or whose terms no
document has, give no row; empty tables give an empty result. Only doc_id, item_id
and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.llm.base import join_with_hot, written

#: Terms are maximal runs of ASCII letters and digits and of all that is beyond ASCII; A-Z in lower case.
_TERMS = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))
FILTER_BITS = 1 << 23
RESULT = "item_id long, rank int, doc_id long, score long"
BUNDLE = "slice int, chunk int, item_id long, ids array<long>, owners array<int>, tops array<long>, rows binary, docs binary, scores binary"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def hashed(term: bytes) -> int:
    """As Spark's xxhash64, to a bit of the filter."""
    return xxhash.xxh64_intdigest(term, 42) % FILTER_BITS


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each distinct term of each item once."""

    def split(batches):
        for b in batches:
            found = [sorted(set(terms(t))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([t for f in found for t in f], pa.string())], ["item_id", "term"])

    one = items.groupBy(items["item_id"].cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    return one.mapInArrow(split, "item_id long, term string")


def filter_of(distinct_terms: DataFrame) -> bytes:
    """The bitmap of the terms' hashes; FILTER_BITS / 64 rows reach the driver at most."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    # The unsigned remainder: the modulus is a power of two.
    words = distinct_terms.select(F.floor(bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {FILTER_BITS}) % 64 as int))").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.astype("<i8").tobytes()


def postings(docs: DataFrame, asked: bytes) -> DataFrame:
    """(row, doc_id, n, term, tf): for each document one row without a term and one for each term that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def count(batches):
        bits, known = sent.value, {}
        for b in batches:
            at, sizes, words, times = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                found = terms(text)
                at.append(k)
                sizes.append(len(found))
                words.append(None)
                times.append(0)
                if len(known) > 500_000:
                    known.clear()
                for w, tf in Counter(found).items():
                    there = known.get(w)
                    if there is None:
                        h = hashed(w)
                        there = known[w] = bits[h >> 3] >> (h & 7) & 1
                    if there:
                        at.append(k)
                        sizes.append(len(found))
                        words.append(w)
                        times.append(tf)
            where = pa.array(at, pa.int64())
            cols = [b.column(0).take(where), b.column(1).take(where), pa.array(sizes, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n", "term", "tf"])

    # A row's number is even where it has a doc_id.
    row = (F.monotonically_increasing_id() * 2 + F.isnull("doc_id").cast("long")).alias("row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "row long, doc_id long, n long, term string, tf long")


def owners(weighed: DataFrame, stages: int) -> dict[int, int]:
    """The owner of each class of terms (floor of log2 df): at most 64 rows reach the driver."""
    sums = sorted((r["class"], r["mass"]) for r in weighed.groupBy("class").agg(F.sum("df").alias("mass")).collect())
    total, before, out = sum(m for _, m in sums), 0, {}
    for c, mass in sums:
        out[c] = min(stages - 1, stages * before // max(total, 1))
        before += mass
    return out


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th best score; 0 with fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def accumulated(acc: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...], ahead: int, rest: int, k: int) -> tuple[np.ndarray, ...]:
    """Accumulators (rows ascending, doc_ids, scores) with new contributions.

    `ahead` is the most that this stage and later ones can add to a document, `rest`
    the most that later ones can.
    """
    rows, docs, scores = acc
    if len(new[0]) and ahead < kth(scores, k):  # a document that isn't here can't come in any more
        there = np.isin(new[0], rows)
        new = tuple(x[there] for x in new)
    if len(new[0]):
        rows, docs, scores = (np.concatenate([a, b]) for a, b in zip((rows, docs, scores), new, strict=True))
        order = np.argsort(rows, kind="stable")
        rows, docs, scores = rows[order], docs[order], scores[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rows, docs, scores = rows[starts], docs[starts], np.add.reduceat(scores, starts)
    stays = scores + rest >= kth(scores, k)
    return rows[stays], docs[stays], scores[stays]


def best_of(rows: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then doc_id with null last."""
    some = np.flatnonzero(scores > 0)
    return some[np.lexsort((rows[some], docs[some], rows[some] & 1, -scores[some]))[:k]]


def visit(owner: int, k: int):
    """One stage: every bundle of a slice and chunk meets the owner's postings there."""

    def run(_, bundles: pa.Table, found: pa.Table) -> pa.Table:
        b = bundles.combine_chunks()
        order = np.argsort(found.column("id").to_numpy(), kind="stable")
        ids, rows, docs, gain = (found.column(c).to_numpy()[order] for c in ("id", "row", "doc_id", "gain"))
        held = [[], [], []]
        for n in range(b.num_rows):
            mine, owned, tops = (np.array(b.column(c)[n].as_py(), np.int64) for c in ("ids", "owners", "tops"))
            acc = tuple(np.frombuffer(b.column(c)[n].as_py(), np.int64) for c in ("rows", "docs", "scores"))
            own = mine[owned == owner]
            lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            at = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)]) if len(own) else np.zeros(0, np.int64)
            acc = accumulated(acc, (rows[at], docs[at], gain[at]), int(tops[owned >= owner].sum()), int(tops[owned > owner].sum()), k)
            for column, x in zip(held, acc, strict=True):
                column.append(x.tobytes())
        return pa.table([*(b.column(c) for c in b.column_names[:-3]), *(pa.array(c, pa.binary()) for c in held)], names=b.column_names)

    return run


def selected(k: int):
    """The k best documents of each bundle as rows."""

    def run(batches):
        for b in batches:
            items, out = [], [[], [], []]
            for n in range(b.num_rows):
                rows, docs, scores = (np.frombuffer(b.column(c)[n].as_py(), np.int64) for c in (1, 2, 3))
                top = best_of(rows, docs, scores, k)
                items += [n] * len(top)
                for column, x in zip(out, (rows, docs, scores), strict=True):
                    column += x[top].tolist()
            docs = pa.array(out[1], pa.int64(), mask=np.array(out[0], np.int64) & 1 == 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(items, pa.int64())), pa.array(out[0], pa.int64()), docs, pa.array(out[2], pa.int64())], ["item_id", "row", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, stages: int = 4, slice_size: int = 4096, chunk_terms: int = 10_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of `docs` (doc_id, text) for each of `items` (item_id, text)."""
    spark = docs.sparkSession
    pairs = written(item_terms(items), "items")
    distinct = written(pairs.select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "terms")
    found = written(postings(docs, filter_of(distinct)), "postings")
    n_docs, words = found.where("term is null").agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not words:
        return spark.createDataFrame([], RESULT)
    df = found.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(distinct.join(df, "term").select("term", "id", "df", weight.alias("w"), F.floor(F.log2("df") + 1e-9).cast("int").alias("class")), "weighed")
    owned = owners(weighed, stages)
    chunks = max(1, -(-pairs.count() // chunk_terms))
    slices = max(1, -(-n_docs // slice_size))
    chunk = F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int")
    # The chunks of items that ask for a term: as many as there are chunks, at most.
    wanted = pairs.select("term", chunk.alias("chunk")).groupBy("term").agg(F.collect_set("chunk").alias("chunks"))
    owner = F.coalesce(*(F.when(F.col("class") == c, o) for c, o in owned.items()), F.lit(0)).cast("int")
    known = written(weighed.join(wanted, "term").select("term", "id", "w", "df", "chunks", owner.alias("owner")), "known")
    length = F.expr(f"10L + (cast(90L * n as decimal(19, 0)) * cast({n_docs} as decimal(18, 0))) div cast({words} as decimal(18, 0))")
    gain = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    gains = join_with_hot(found.where("term is not null"), known, "term", "df").withColumn("m", length)
    gains = gains.select("id", "owner", "chunks", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), "row", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), gain.alias("gain"))
    gains = written(gains, "gains")
    tops = gains.groupBy("id").agg(F.max("gain").alias("top"))
    each = pairs.join(known.select("term", "id", "owner"), "term").join(tops, "id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("owner", "id", "top"))).alias("t"))
    none = F.lit(b"")
    bundles = each.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        chunk.alias("chunk"),
        "item_id",
        F.col("t.id").alias("ids"),
        F.col("t.owner").alias("owners"),
        F.col("t.top").alias("tops"),
        none.alias("rows"),
        none.alias("docs"),
        none.alias("scores"),
    )
    for o in sorted(set(owned.values())):
        own = gains.where(F.col("owner") == o).select("slice", F.explode("chunks").alias("chunk"), "id", "row", "doc_id", "gain")
        bundles = bundles.groupBy("slice", "chunk").cogroup(own.groupBy("slice", "chunk")).applyInArrow(visit(o, k), BUNDLE)
    tops = bundles.select("item_id", "rows", "docs", "scores").mapInArrow(selected(k), T.StructType.fromDDL("item_id long, row long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

