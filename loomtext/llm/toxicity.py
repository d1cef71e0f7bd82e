"""Toxicity by a classifier chain.

Categories are predicted in a fixed order. Category j's linear model sees the
text's features and the probabilities of categories 1 to j-1. For training,
those earlier probabilities are out-of-fold predictions, so that a later model
learns from what it will see on new documents.

Features: for each of `terms` indicative words, min(count, 4), and the same for
the words with a strong positive association taken together. Indicative are
the words whose presence in labelled documents tells most about being in any
category (chi-squared), counted by Spark over the whole sample with 64-bit word
hashes.

Categories are columns of the label table, in the chain's order
(`categories`). From a table of a single one two more are derived, which stand
before it in the chain, so that the label's model sees their probabilities. They
come, for the rows of each of five folds, from what the other folds show: ``severe`` (the label,
and the share of the words that speak strongly for it is above the median of
the other folds' labelled rows) and ``varied`` (the label, and three or more
distinct such words).

A document is rejected if any category's probability along the chain is over
the threshold.

Training reads about `per_class` rows of each class (a row of any category, a
row of none), chosen by hashes of the documents' ids: a documented bound. All
documents are scored, over whole texts.

Defined cases: null, empty and word-less texts have probabilities of a text
without any indicative word; without labelled documents of both classes the
models are smoothed rates and nothing is rejected; documents labelled more
than once take the highest label of each category; rows with a null label in
any of the categories don't count; rows that repeat stay apart; an empty table
gives an empty result; columns called like the result's (p_<category>,
rejected) are replaced, other columns are handed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.base import WordHasher, fit_logistic, folds_of, sigmoid, written

MOST, FOLDS = 4, 5


def labelled_ids(labels: DataFrame, columns: list[str], per_class: int, seed: int = 23) -> DataFrame:
    """(doc_id, y, c0, c1, ...): about per_class ids of each class, at most 3 * per_class; y is 1 where any of the 0/1 label columns c0, c1, ... is."""
    each = [(F.max(labels[c].cast("int")) > 0).cast("int").alias(f"c{i}") for i, c in enumerate(columns)]
    there = labels["doc_id"].isNotNull()
    for c in columns:
        there &= labels[c].isNotNull()
    known = labels.where(there).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(*each)
    known = known.withColumn("y", F.greatest("c0", *(f"c{i}" for i in range(len(columns)))) if len(columns) > 1 else F.col("c0"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, min(1.0, per_class / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return known.withColumn("draw", draw).where(F.col("draw") < share).orderBy("draw", "doc_id").limit(3 * per_class).drop("draw")


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], per_class: int) -> DataFrame:
    """(doc_id, y, c0, ..., fold, text) of the documents that labelled_ids names."""
    chosen = labelled_ids(labels, columns, per_class)
    own = [c for c in chosen.columns if c != "doc_id"]
    text = docs.where("text is not null").select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    # The chosen ids are at most 3 * per_class rows. One row for each id: of rows that repeat it, the smallest text.
    found = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *own).agg(F.min("text").alias("text"))
    return found.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(FOLDS)).cast("int"))


def word_presence(sample: DataFrame) -> DataFrame:
    """(y, fold, h): the distinct word hashes of each sampled text."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for y, fold, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.unique(hasher.hashes(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), y, np.int32)), pa.array(np.full(len(h), fold, np.int32)), pa.array(h)], ["y", "fold", "h"])

    return sample.select("y", "fold", "text").mapInArrow(run, "y int, fold int, h long")


def speaks_strongly(p: np.ndarray, seen: np.ndarray, pos: float, neg: float, least: int) -> np.ndarray:
    """Which words, found in p positive rows of `seen` rows, have a strong positive association."""
    odds = np.log((p + 0.5) / (pos + 1.0)) - np.log((seen - p + 0.5) / (neg + 1.0))
    return (odds > 3) & (p >= max(least, 0.02 * pos))


def indicative_words(sample: DataFrame, terms: int, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the most indicative words, which of them speak strongly for the label, and which do by all folds but one (a row for each fold)."""
    by_fold = {r["fold"]: (r["n"], r["p"] or 0) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    n, pos = (sum(v[i] for v in by_fold.values()) for i in (0, 1))
    if not pos or pos == n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((FOLDS, 0), bool)
    per = [F.sum(F.when(F.col("fold") == f, v).otherwise(0)).alias(f"{name}{f}") for f in range(FOLDS) for name, v in (("p", F.col("y")), ("n", F.lit(1)))]
    seen = word_presence(sample).groupBy("h").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("all"), *per).where(F.col("all") >= least)
    expected = F.col("all") * (pos / n)
    chi = (F.col("p") - expected) ** 2 / (expected * (1 - F.col("all") / (n + 1)))
    rows = seen.withColumn("chi", chi).orderBy(F.desc("chi"), "h").limit(terms).collect()
    rows.sort(key=lambda r: r["h"])
    column = lambda name: np.array([r[name] for r in rows], float)
    strong = speaks_strongly(column("p"), column("all"), pos, n - pos, least)
    others = []
    for f in range(FOLDS):
        own_n, own_p = by_fold.get(f, (0, 0))
        others.append(speaks_strongly(column("p") - column(f"p{f}"), column("all") - column(f"n{f}"), pos - own_p, n - pos - own_n + own_p, least))
    return np.array([r["h"] for r in rows], np.int64), strong, np.array(others, bool).reshape(FOLDS, len(rows))


def derived(count: np.ndarray, words: np.ndarray, y: np.ndarray, fold: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Columns y, severe, varied; each fold's rows are judged by the words and the median of the others. words: the rows' numbers of words."""
    out = np.column_stack([y, np.zeros(len(y)), np.zeros(len(y))])
    for f in range(FOLDS):
        own, other = (fold == f) & (y > 0), (fold != f) & (y > 0)
        share = count[:, strong[f]].sum(1) / np.maximum(words, 1)
        out[own, 1] = share[own] > (np.median(share[other]) if other.any() else 0.0)
        out[own, 2] = (count[own][:, strong[f]] > 0).sum(1) >= 3
    return out


def with_sum(count: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The chain's features of rows of counts."""
    return np.minimum(np.column_stack([count, count[:, strong].sum(1)]), MOST)


def counts_of(hasher: WordHasher, text: str | None, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the (sorted) words occurs, and the number of words."""
    h = hasher.hashes(text).view(np.int64)
    if not len(words):
        return np.zeros(0), len(h)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.bincount(at[words[at] == h], minlength=len(words)).astype(float), len(h)


class Chain:
    """Linear models of the categories in order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, categories: list[str], l2: float = 0.1, fold: np.ndarray | None = None) -> None:
        self.categories, self.models = categories, []
        fold = folds_of(y[:, 0], FOLDS) if fold is None else fold
        earlier = np.zeros((len(x), 0))
        for j in range(len(categories)):
            z = np.column_stack([x, earlier])
            self.models.append(fit_logistic(z, y[:, j], l2))
            held_out = np.empty(len(x))
            for f in range(FOLDS):
                own = fold == f
                held_out[own] = self._apply(fit_logistic(z[~own], y[~own, j], l2), z[own])
            earlier = np.column_stack([earlier, held_out])
        self.out_of_fold = earlier

    @staticmethod
    def _apply(beta: np.ndarray, z: np.ndarray) -> np.ndarray:
        return sigmoid(z @ beta[:-1] + beta[-1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        earlier = np.zeros((len(x), 0))
        for beta in self.models:
            earlier = np.column_stack([earlier, self._apply(beta, np.column_stack([x, earlier]))])
        return earlier


def train(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, per_class: int = 2000, terms: int = 192):
    """(words, strong, chain); the sample's counts of indicative words are all that reaches the driver."""
    categories = categories or ["toxic"]
    sample = written(labelled_sample(docs, labels, categories, per_class), "labelled")
    words, strong, others = indicative_words(sample, terms)
    labelled = [f"c{i}" for i in range(len(categories))]
    own = ["doc_id", "fold", *labelled]

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            rows = [counts_of(hasher, t, words) for t in b.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int64())], [*own, "x", "n"])

    rows = sample.select(*own, "text").mapInArrow(run, "doc_id long, fold int" + "".join(f", {c} int" for c in labelled) + ", x array<double>, n long").collect()
    rows.sort(key=lambda r: r["doc_id"])
    count = np.array([r["x"] for r in rows], float).reshape(len(rows), len(words))
    y = np.array([[r[c] for c in labelled] for r in rows], float).reshape(len(rows), len(labelled))
    fold = np.array([r["fold"] for r in rows], int)
    if len(categories) == 1:
        y = derived(count, np.array([r["n"] for r in rows], float), y[:, 0], fold, others)[:, [1, 2, 0]]
        categories = ["severe", "varied", *categories]
    return words, strong, Chain(with_sum(count, strong), y, list(categories), fold=fold)


def score(docs: DataFrame, words: np.ndarray, strong: np.ndarray, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """All columns of docs and p_<category> for each category, and `rejected`: any category's probability is over the threshold."""
    names = [f"p_{c}" for c in chain.categories]
    own = [c for c in docs.columns if c not in names and c != "rejected"]
    docs = docs.select(*own)
    at = own.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((words, strong, chain))  # `terms` words, three models

    def run(batches):
        words, strong, chain = shared.value
        usable = len(words) > 0  # else there was no sample of both classes
        hasher = WordHasher()
        for b in batches:
            x = np.array([counts_of(hasher, t, words)[0] for t in b.column(at).to_pylist()], float).reshape(b.num_rows, len(words))
            p = chain.predict(with_sum(x, strong))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in p.T), pa.array((p > threshold).any(1) & usable)], [*own, *names, "rejected"])

    added = [T.StructField(c, T.DoubleType()) for c in names] + [T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, per_class: int = 2000, terms: int = 192, threshold: float = 0.5) -> DataFrame:
    """The documents with each category's probability and the decision; `categories` are the label table's 0/1 columns in the chain's order (toxic)."""
    return score(docs, *train(docs, labels, categories, per_class, terms), threshold)
