"""Substring dedup by hashed lines and by hashed runs of their units.

A line is one unit of comparison; inside lines there is a finer level, so that
a passage set into the middle of a line is found too. A line's units end at
sentence ends, and, from the `AFTER`-th word of a sentence on, after words whose
hash is divisible by EVERY: cuts depend on nearby words alone, so that the same
passage is cut alike wherever it stands, whatever its sentences' lengths.

Two kinds of digests (96 bits, of lower-cased words joined by one space) are
grouped globally, and the occurrence of the lowest (doc_id, text hash, position)
stays:

* whole lines of `short_words` words or more;
* runs: from a unit's start on, the fewest whole units that have `run_words`
  words together. A run is hashed as a whole, short units included, so that all
  that goes with it stands there in the earlier text too, one word after the other.

Removed are

* a whole line, of whatever length, that the same text has had before,
* a whole line of `short_words` words or more that is a repeat across texts
  (`line_words` where it is the text's only line: such a text is a short document), and
* every run that is a repeat.

Nothing else is removed: each removed word is part of a line or of a run that
an earlier text (or an earlier place of the same text) has as a whole, and
every unit stays at least once in the table. Removed spans keep their
code-point offsets in the original text; a span takes the blanks after it along.

One shuffle groups the digests. Digests that could be hot are found beforehand
from counts in `buckets` hash buckets, a table that is broadcast (at most four
rows for each shuffle partition); those are grouped by partial minima
instead and meet the minima again in as many salted pieces as their bucket's
count asks for.

Defined cases: a null text stays null and has no lines; a text that is all
repeats becomes empty, its row stays; rows of the same doc_id and text are one
occurrence and get the same decision; a null doc_id ranks first; an empty
table gives an empty result; other columns, of whatever names, are handed on
as they are (but for `removed` and `n_removed`, which are the result's own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.llm.base import fresh, written

EVERY, AFTER = 8, 4
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def lowered(text: str) -> str:
    """Lower case with as many code points (one capital has two small ones)."""
    return text.replace("İ", "i").lower()


class Units:
    """A text's words, and its units as ranges of words.

    start, end: bytes of each word in the lower-cased UTF-8; first, last: the
    words of each unit; norm, at: the words joined by one space, and where each
    begins there.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        data = lowered(text).encode("utf-8", "surrogatepass")
        b = self.bytes = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~_BLANK[b]
        change = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = self.start, self.end = change[::2], change[1::2]
        self.norm = b" ".join(data.split())
        self.at = np.cumsum(end - start + 1) - (end - start + 1)
        n = len(start)
        if not n:
            self.first = self.last = np.zeros(0, int)
            return
        line = np.searchsorted(np.flatnonzero(b == 10), start)
        breaks = np.append(line[1:] != line[:-1], True)
        stops = breaks | _STOP[b[end - 1]]
        words = np.arange(n)
        since = words - np.append(-1, np.maximum.accumulate(np.where(stops, words, -1))[:-1])
        cut = stops | ((since >= AFTER) & (cut_hash(b[start], b[(start + end) // 2], b[end - 1], end - start) % EVERY == 0))
        self.last = np.flatnonzero(cut)
        self.first = np.append(0, self.last[:-1] + 1)

    def runs(self, run_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last units of all runs; the last units of a text start none if they have too few words."""
        end = np.searchsorted(self.last, self.first + run_words - 1)
        n = int(np.count_nonzero(end < len(self.last)))
        return np.arange(n), end[:n]

    def slices(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Normalised words from unit first[i] to unit last[i]."""
        a, z = self.first[first], self.last[last]
        return [self.norm[p:q] for p, q in zip(self.at[a].tolist(), (self.at[z] + self.end[z] - self.start[z]).tolist(), strict=True)]

    def offsets(self, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
        """Code-point offsets from unit first[i] to unit last[i]."""
        a, z = self.start[self.first[first]], self.end[self.last[last]]
        if not self.text.isascii():
            points = np.cumsum((self.bytes & 0xC0) != 0x80)
            a, z = points[a] - 1, points[z - 1]
        return list(zip(a.tolist(), z.tolist(), strict=True))


def cut_hash(first: np.ndarray, middle: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of a word's first, middle and last byte and of its length in bytes."""
    h = first.astype(np.uint32) * 31 + middle.astype(np.uint32) * 131 + last.astype(np.uint32) * 7 + size.astype(np.uint32) * 1009
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def units_of(text: str):
    """(start, end, digest, words, whole line) of every unit; offsets in code points."""
    u = Units(text)
    every = np.arange(len(u.first))
    for (a, z), data, n in zip(u.offsets(every, every), u.slices(every, every), (u.last - u.first + 1).tolist(), strict=True):
        yield a, z, xxhash.xxh3_128_digest(data), n, text[a - 1 : a] in ("", "\n") and text[z : z + 1] in ("", "\n")


def lines_of(text: str):
    """(start, end, normalised bytes, words) of every line that has words; offsets in code points."""
    at = 0
    for line in text.split("\n"):
        if words := lowered(line).encode("utf-8", "surrogatepass").split():
            yield at, at + len(line), b" ".join(words), len(words)
        at += len(line) + 1


def _explode(run_words: int, short_words: int):
    """Runs by their first unit's number from 0 on, whole lines by -1, -2, ..."""
    digest = xxhash.xxh3_128_digest

    def run(batches):
        for b in batches:
            ids, keys, numbers, digests = [], [], [], []
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                u = Units(text)
                first, last = u.runs(run_words)
                found = [digest(s) for s in u.slices(first, last)]
                lines = [(-n - 1, digest(b"\n" + data)) for n, (_, _, data, words) in enumerate(lines_of(text)) if words >= short_words]
                numbers += first.tolist() + [n for n, _ in lines]
                digests += found + [d for _, d in lines]
                ids += [doc] * (len(found) + len(lines))
                keys += [key] * (len(found) + len(lines))
            words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "unit", "d1", "d2"])

    return run


def repeats(docs: DataFrame, run_words: int = 10, short_words: int = 3, buckets: int = 1 << 16) -> DataFrame:
    """(doc_id, key, unit): every occurrence of a run or a whole line but the earliest."""
    spark = docs.sparkSession
    found = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("key"), docs["text"].alias("text"))
    units = written(found.mapInArrow(_explode(run_words, short_words), "doc_id long, key long, unit int, d1 long, d2 int"), "units")
    bucket = F.pmod(F.col("d1"), F.lit(buckets)).cast("int")
    # At most `buckets` rows; hot are at most 4 * shuffle partitions of them.
    sizes = written(units.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    limit = max(256, (total or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    some = (most or 0) > limit
    hot = F.broadcast(sizes.where(F.col("n") > limit).select("b", F.ceil(F.col("n") / limit).cast("int").alias("salts")))

    rank = F.struct("doc_id", "key", F.abs("unit").alias("unit"))
    marked = units.withColumn("b", bucket)
    cold = (marked.join(hot, "b", "left_anti") if some else marked).withColumn("first", F.min(rank).over(Window.partitionBy("d1", "d2"))).where(rank != F.col("first"))
    out = cold.select("doc_id", "key", "unit")
    if some:
        warm = marked.join(hot, "b")
        first = warm.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"), F.min("salts").alias("salts")).where("n > 1")
        first = first.select("d1", "d2", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        met = warm.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "unit"), F.col("salts")).cast("int")).join(first, ["d1", "d2", "salt"])
        out = out.unionByName(met.where(rank != F.col("first")).select("doc_id", "key", "unit"))
    return out


def lines_again(text: str) -> list[tuple[int, int]]:
    """The spans of lines that have words and stand further up in the same text, normalised."""
    seen, spans = set(), []
    for start, end, data, _ in lines_of(text) if "\n" in text else ():
        # A digest for a long line, so that memory does not follow the text.
        key = xxhash.xxh3_128_digest(data) if len(data) > 64 else data
        if key in seen:
            spans.append((start, end))
        seen.add(key)
    return spans


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def run_spans(text: str, repeated: list[int], run_words: int) -> list[tuple[int, int]]:
    """The spans of all units in repeated runs, given these runs' first units; neighbours are one, with the blanks after them."""
    u = Units(text)
    first, last = u.runs(run_words)
    own = np.isin(first, repeated)
    edge = np.zeros(len(u.first) + 1, int)
    np.add.at(edge, first[own], 1)
    np.add.at(edge, last[own] + 1, -1)
    gone = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    change = np.flatnonzero(gone[1:] != gone[:-1])
    spans = []
    for start, end in u.offsets(change[::2], change[1::2] - 1):
        while end < len(text) and text[end] in " \t":
            end += 1
        spans.append((start, end))
    return spans


def spans_of(text: str, repeated: list[int], line_words: int, run_words: int) -> list[tuple[int, int]]:
    """The spans of a text to remove, given the numbers of its repeated runs and lines."""
    spans = lines_again(text)
    if any(n >= 0 for n in repeated):
        spans += run_spans(text, [n for n in repeated if n >= 0], run_words)
    if any(n < 0 for n in repeated):
        again, lines = set(repeated), list(lines_of(text))
        spans += [(a, z) for n, (a, z, _, words) in enumerate(lines) if -n - 1 in again and (len(lines) > 1 or words >= line_words)]
    return joined_spans(spans)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a span that leaves an empty line takes its line break along."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
        if (start == 0 or text[start - 1] == "\n") and at < len(text) and text[at] == "\n":
            at += 1
    out.append(text[at:])
    return "".join(out)


def dedup_substrings(docs: DataFrame, line_words: int = 8, run_words: int = 10, short_words: int = 3) -> DataFrame:
    """The documents with their repeated lines and runs cut: `text` without them, `removed` with the offsets of what went, `n_removed` code points."""
    names = [c for c in docs.columns if c not in ("removed", "n_removed")]
    docs = docs.select(*(docs[c] for c in names))
    doc, k, key, found = fresh(names, "doc", "k", "key", "units")
    drop = repeats(docs, run_words, short_words).groupBy(F.col("doc_id").alias(doc), F.col("key").alias(k)).agg(F.collect_set("unit").alias(found))  # at most the units of one text
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(drop, keyed["doc_id"].cast("long").eqNullSafe(drop[doc]) & (keyed[key] == drop[k]), "left").select(*names, found)
    text_at = names.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            texts, removed, count = [], [], []
            for text, units in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                spans = spans_of(text, units or [], line_words, run_words) if text else []
                texts.append(without(text, spans) if spans else text)
                removed.append([{"start": a, "end": e} for a, e in spans])
                count.append(len(text) - len(texts[-1]) if text else 0)
            cols = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, span), pa.array(count, pa.int64())], [*names, "removed", "n_removed"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [T.StructField("removed", spans), T.StructField("n_removed", T.LongType())]
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
