"""Language identification by hierarchical discrimination.

Linear support vector machines first tell the language family, each family
against the others; within the family one-versus-one machines separate each
pair of languages, and the language with the most votes (then the largest summed
margin) wins. A language outside the table of families is a family of its own,
so that there are about as many machines as languages.

Features: counts of hashed pairs and triples of lower-cased bytes of the whole
text, with everything but letters as one space; square roots, scaled to unit
length. All work on a text is a few numpy passes over its bytes.

Training reads for each language the `per_language` rows of the smallest hashes
of their ids (a documented bound; languages with fewer rows give all). With so
many languages that this exceeds `most_rows` rows, every language gives
most_rows / languages of them, one at least. These rows' vectors of 6,144
numbers reach the driver.

Defined cases: null texts and texts without a letter (Unicode category L) get
``und`` with score 0; without training rows every other text gets ``und`` too;
with one language every text with a letter gets it; rows that repeat stay
apart; an empty table gives an empty result; only doc_id, text and lang are
read, and lang only of training rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.base import PIECE, sigmoid

#: Families by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
}
PAIRS, TRIPLES = 2048, 4096
_ASCII = re.compile("[A-Za-z]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    data = b" " + text.encode("utf-8", "surrogatepass").translate(_LOWER) + b" "
    count = np.zeros(PAIRS + TRIPLES)
    for at in range(0, len(data), PIECE):
        # Pairs and triples that begin in this piece, two bytes beyond it included.
        c = np.frombuffer(data[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        two = (c[:-1] * np.uint32(31) + c[1:])[:PIECE]
        blank = ((c[:-1] == 32) & (c[1:] == 32))[:PIECE]
        three = two[: len(c) - 2] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA6B)
        count[:PAIRS] += np.bincount(two[~blank] % PAIRS, minlength=PAIRS)
        count[PAIRS:] += np.bincount((three[~blank[: len(three)]] >> 16) % TRIPLES, minlength=TRIPLES)
    x = np.sqrt(count)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, passes: int = 40) -> np.ndarray:
    """Weights (last: intercept) of a linear machine with squared hinge loss, by dual coordinate ascent; y is -1 or 1."""
    a = np.column_stack([x, np.ones(len(x), np.float32)])
    gram = (a @ a.T).astype(float) * np.outer(y, y)
    curve = gram.diagonal() + 1 / (2 * c)
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(passes):
        moved = 0.0
        for i in range(len(y)):
            new = max(alpha[i] - (grad[i] + alpha[i] / (2 * c)) / curve[i], 0.0)
            if new != alpha[i]:
                grad += gram[i] * (new - alpha[i])
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return (alpha * y) @ a


class Hierarchy:
    """The families' machines and the pairwise machines of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        names = np.array(langs)
        kin = np.array([family_of(n) for n in langs])
        self.families = sorted(set(kin.tolist()))
        self.top = np.array([fit_svm(x, np.where(kin == f, 1.0, -1.0)) for f in self.families], np.float32) if len(self.families) > 1 else None
        self.within = {f: self.pairwise(x[kin == f], names[kin == f]) for f in self.families}

    @staticmethod
    def pairwise(x: np.ndarray, labels: np.ndarray):
        classes = sorted(set(labels.tolist()))
        pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
        w = []
        for i, j in pairs:
            rows = np.flatnonzero((labels == classes[i]) | (labels == classes[j]))
            w.append(fit_svm(x[rows], np.where(labels[rows] == classes[i], 1.0, -1.0)))
        return classes, pairs, np.array(w, np.float32)

    def family(self, x: np.ndarray) -> tuple[str, float]:
        """The family of the largest margin."""
        if self.top is None:
            return self.families[0], 1.0
        margin = self.top[:, :-1] @ x + self.top[:, -1]
        best = int(np.argmax(margin))
        return self.families[best], float(sigmoid(2 * np.array(margin[best])))

    @staticmethod
    def choose(machine, x: np.ndarray) -> tuple[str, float]:
        classes, pairs, w = machine
        if not pairs:
            return classes[0], 1.0
        margin = w[:, :-1] @ x + w[:, -1]
        votes, total = np.zeros(len(classes)), np.zeros(len(classes))
        worst = np.full(len(classes), np.inf)
        for (i, j), m in zip(pairs, margin.tolist(), strict=True):
            votes[i if m >= 0 else j] += 1
            total[i] += m
            total[j] -= m
            worst[i], worst[j] = min(worst[i], m), min(worst[j], -m)
        best = max(range(len(classes)), key=lambda k: (votes[k], total[k], -k))
        return classes[best], float(sigmoid(2 * np.array(worst[best])))

    def predict(self, text: str) -> tuple[str, float]:
        x = features(text)
        family, a = self.family(x)
        lang, b = self.choose(self.within[family], x)
        return lang, a * b


def training_sample(docs: DataFrame, usable: Column, per_language: int, most_rows: int) -> DataFrame:
    """(lang, text) of at most per_language rows for each language, by hash of doc_id."""
    labelled = docs.where(usable & docs["lang"].isNotNull() & docs["text"].isNotNull()).select("doc_id", "lang", "text")
    # A row for each language; each has a machine on the driver anyway.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled.select("lang", "text")
    each = max(1, min(per_language, most_rows // len(counts)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    # About twice as many as are taken (and eight more) go into the ranking, so that no language is short of rows.
    limits = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2.0 * each + 8) / n))))
    rows = labelled.withColumn("draw", draw).where(F.col("draw") < F.element_at(limits, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("lang", "text")


def train(docs: DataFrame, usable: Column, per_language: int = 300, most_rows: int = 3000) -> Hierarchy | None:
    def run(batches):
        for b in batches:
            rows = [(lang, features(t)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.float16).tobytes() for r in rows], pa.binary())], ["lang", "x"])

    # Sorted, so that the same rows give the same model whatever their order of arrival.
    rows = training_sample(docs, usable, per_language, most_rows).mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return None
    return Hierarchy(np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32), [r["lang"] for r in rows])


def identify(docs: DataFrame, usable: Column, per_language: int = 300, most_rows: int = 3000) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; `usable` says which documents the machines may learn from."""
    model = train(docs, usable, per_language, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about as many machines of 6,145 numbers as languages

    def run(batches):
        m = shared.value
        for b in batches:
            out = [m.predict(t) if m and has_letter(t) else ("und", 0.0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double")
