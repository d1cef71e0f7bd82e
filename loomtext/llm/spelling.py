"""Grouping of spelling variants over an index of variable-length grams.

1. Words are counted over all texts; a task sums its own words before the shuffle.
2. Gram dictionary: starting with grams of 2 code points, a gram is extended as long
   as it is frequent (more than a `share`-th of all places) and shorter than the
   longest allowed. Rare grams have no extensions: the dictionary is pruned by
   frequency, and no two of its grams begin each other. Only the frequent ones are
   needed to read a word; there are at most `share` of each length.
3. A word is decomposed into one variable gram for each place: from there the gram
   of the dictionary, or what is left of the word.
4. Affected grams: for each place of an edit, those grams that contain it (an
   insertion: around it; at the word's end also those cut short by the end). The
   largest such number, over all places, is the word's bound: one edit leaves all
   but so many of its grams unchanged, at the same place before the edit and one
   further behind it. Words of l code points are compared with ones of l and l + 1
   by grams of at most min(`longest`, l - 2), so that a gram is always left.
5. List merging: of a word's grams, bound + `hits` lists are read (all, if
   fewer), those of rare grams first. A near word stands in `hits` of them at
   least (in all but `bound`, if fewer are read): the merged counts decide about candidates.
6. Candidates are verified: edit distance exactly one.

Each word's form is its most frequent near word where that is `times` as frequent;
roots follow by pointer doubling, since numbers grow along forms.

No join is a broadcast, as both sides grow with the words: Spark sizes the grams by
the words' compressed file, many times too low, and would send them through the driver.

Defined cases: null texts have no word; a null doc_id gives no deletion (its runs
have no checksum); rows that repeat are counted each; an empty table gives an empty
result. Only doc_id and text are read. doc_id may be of any type: its text is used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import discard, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_UP = {c: c + 32 for c in range(65, 91)}
_LOWER = bytes.maketrans(bytes(_UP), bytes(_UP.values()))
SHORTEST = 2


def slip(doc_id: str, run: str, every: int) -> str:
    """The run, without one of its code points where its checksum says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, least: int = 6, times: int = 5, every: int = 199, kept: int = 200_000) -> DataFrame:
    """(word, n): words of at least `least` code points that occur `times` times over all texts.

    A task holds at most `kept` words, and hands on their sums before it takes more.
    """

    def count(batches):
        sums: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return rows

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs = Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
                for run, n in runs.items():
                    if len(run) >= least:
                        word = run if doc_id is None else slip(doc_id, run, every)
                        if len(word) >= least:
                            sums[word] += n
                if len(sums) > kept:
                    yield out()
        yield out()

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def frequent_grams(words: DataFrame, longest: int, share: int, rare: int) -> set[str]:
    """Grams of fewer than `longest` code points that are extended: more than a `share`-th of all places, and more than `rare`, have them."""
    places = words.agg(F.sum(F.length("word") - 1)).first()[0] or 0
    limit = max(rare, places // share)
    of = lambda q: F.transform(F.sequence(F.lit(1), F.length("word") - (q - 1)), lambda k: F.substring(F.col("word"), k, F.lit(q)))
    grams = words.where(F.length("word") >= longest).select(F.explode(F.concat(*(of(q) for q in range(SHORTEST, longest)))).alias("gram"))
    # At most `share` grams of each length are over the limit.
    return {r["gram"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("gram").collect()}


def decomposed(word: str, frequent: set[str], longest: int) -> list[tuple[int, bool]]:
    """For each place the length of its gram, and whether the gram ended by being rare."""
    out, size = [], len(word)
    for p in range(size - SHORTEST + 1):
        q = SHORTEST
        while q < longest and p + q < size and word[p : p + q] in frequent:
            q += 1
        out.append((q, word[p : p + q] not in frequent and q < longest))
    return out


def affected(grams: list[tuple[int, bool]], size: int) -> int:
    """How many grams one edit can change, at most."""
    inside, around = [0] * (size + 1), [0] * (size + 1)
    for p, (q, rare) in enumerate(grams):
        for i in range(p, p + q):
            inside[i] += 1
        for i in range(p + 1, p + q):
            around[i] += 1
        if p + q == size and not rare:  # might go on, if the word did
            around[size] += 1
    return max(*inside, *around)


def lists(word: str, frequent: set[str], longest: int, shorter: int, hits: int) -> tuple[list[str], int]:
    """The places and grams whose lists are read for a word against words of `shorter` code points, and in how many of them a near word stands."""
    most = min(longest, shorter - 2)
    grams = decomposed(word, frequent, most)
    bound = affected(grams, len(word))
    order = sorted(range(len(grams)), key=lambda p: (not grams[p][1], -grams[p][0], p))[: bound + hits]
    return [f"{p}{word[p : p + grams[p][0]]}" for p in order], max(1, len(order) - bound)


def near_words(words: DataFrame, longest: int = 6, share: int = 60_000, rare: int = 24, hits: int = 2) -> DataFrame:
    """(word, n, near, near_n): all pairs of words (word, n) that one edit parts, both ways."""
    sent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, longest, share, rare))

    def index(batches):
        """Every word's grams: by place for words of its length, by place and the next one for those one longer."""
        for b in batches:
            at, keys = [], []
            for k, word in enumerate(b.column(0).to_pylist()):
                size = len(word)
                for p, (q, _) in enumerate(decomposed(word, sent.value, min(longest, size - 2))):
                    keys += [f"{size}={p}{word[p : p + q]}", f"{size}+{p}{word[p : p + q]}", f"{size}+{p + 1}{word[p : p + q]}"]
                    at += [k] * 3
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(0).take(where), b.column(1).take(where)], ["key", "near", "near_n"])

    def probe(batches):
        for b in batches:
            at, keys, needs = [], [], []
            for k, word in enumerate(b.column(0).to_pylist()):
                size = len(word)
                for shorter, kind in ((size, "="), (size - 1, "+")):
                    found, need = lists(word, sent.value, longest, shorter, hits)
                    keys += [f"{shorter}{kind}{x}" for x in found]
                    at += [k] * len(found)
                    needs += [need] * len(found)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(0).take(where), b.column(1).take(where), pa.array(needs, pa.int32())], ["key", "word", "n", "need"])

    own = words.select("word", "n")
    read = own.mapInArrow(probe, "key string, word string, n long, need int")
    kept = own.mapInArrow(index, "key string, near string, near_n long")
    met = read.join(kept.hint("merge"), "key").where((F.length("near") < F.length("word")) | (F.col("near") < F.col("word")))
    merged = met.groupBy("word", "near", "n", "near_n", "need").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= F.col("need"))
    found = merged.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(both).alias("x")).select("x.*")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form, ...): each round doubles the way that a root has been followed."""
    roots = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        discard(roots)
        roots = step.drop("moved")
        roots.written_at = step.written_at
        if not moved:
            return roots


def grouped(words: DataFrame, times: int = 5, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = written(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words, **options).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    good = -F.col("best.minus") >= times * F.col("n")
    forms = words.join(near.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"),
        F.when(good, -F.col("best.minus")).alias("form_n"),
    )
    forms = written(forms, "forms")
    roots = rooted(forms).select("word", "root")
    return forms.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
