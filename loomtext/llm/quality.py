"""Quality by co-training: a text view and a page-metadata view teach each other.

Text view: shares of character classes and of each ASCII punctuation sign,
line and word statistics, repeated words. Metadata view: source and language
(hashed to indicator columns) and the length on a log scale.

Each view starts from the labelled sample. In every round each view's model
labels all documents outside the sample; its `growth` most confident ones of
either class, if over `sure`, join the other view's training set. Documents of
the same features are one, so that copies don't take the others' places. After
the rounds both views are calibrated on labelled rows kept apart (Platt), and a
logistic combination of the two calibrated views' log-odds scores all documents.

All features are computed once, over whole texts, and written; rounds and
scoring read that table. Training reads about `per_class` labelled rows of each
class, chosen by hashes of the documents' ids: a documented bound. Each round
hands at most 4 * growth rows to the driver, the best of the whole table.

Defined cases: null texts count as empty ones; null source or lang is a value of
its own; without labelled rows of both classes the score is the smoothed rate;
documents labelled more than once take the highest label, and of rows that
repeat a labelled id the one of the smallest features teaches; rows that repeat
stay apart; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.base import PIECE, WordHasher, fit_logistic, folds_of, sigmoid, written
from loomtext.llm.toxicity import labelled_ids

SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
SOURCES, LANGS = 32, 16


def repeated_lines(data: bytes) -> float:
    """The share of lines that stand further up in the text, for a text of any size; only hashes of lines are held."""
    seen, lines, at = set(), 0, 0
    while at <= len(data) and data:
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        seen.add(xxhash.xxh3_64_intdigest(data[at:end]))
        lines += 1
        at = end + 1
    return 1 - len(seen) / lines if lines else 0.0


def text_view(hasher: WordHasher, text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    c = np.zeros(256)
    for at in range(0, len(data), PIECE):
        c += np.bincount(np.frombuffer(data[at : at + PIECE], np.uint8), minlength=256)
    h = hasher.hashes(text)
    words = max(len(h), 1)
    same = np.count_nonzero(h[1:] == h[:-1]) if len(h) > 1 else 0
    upper, lower, digit, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    repeated = repeated_lines(data)
    shares = np.sqrt(c[SIGNS] / n)
    rest = [
        np.sqrt(upper / n), lower / n, np.sqrt(digit / n), high / n, np.sqrt(c[10] / n), c[32] / n, upper / max(upper + lower, 1),
        np.log1p(len(h)) / 10, np.log1p(len(data) / words) / 3, len(np.unique(h)) / words, same / words, repeated,
        (c[46] + c[33] + c[63]) / words, float(not len(h)),
    ]
    return np.concatenate([shares, rest])


def page_view(source: str | None, lang: str | None, length: int) -> np.ndarray:
    x = np.zeros(SOURCES + LANGS + 3)
    x[zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % SOURCES] = 1
    x[SOURCES + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % LANGS] = 1
    size = np.log1p(length)
    x[-3:] = size / 10, (size / 10) ** 2, float(length < 50)
    return x


def views(hasher: WordHasher, text: str | None, source: str | None, lang: str | None) -> np.ndarray:
    return np.concatenate([text_view(hasher, text), page_view(source, lang, len(text or ""))])


WIDTH = len(SIGNS) + 14


class CoTrained:
    """Both views' models, and what they are taught. x: both views side by side, the text view first; y: 0 or 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> None:
        self.rate = (y.sum() + 0.5) / (len(y) + 1)
        self.taught, self.l2, self.models = [0, 0], l2, None
        if not len(y) or y.min() == y.max():
            return
        # The same spread for both views' training sets and for scoring.
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.spread
        apart = folds_of(y, 4) == 0  # for calibration
        self.cut = [slice(0, WIDTH), slice(WIDTH, x.shape[1])]
        self.sets = [(x[~apart][:, c], y[~apart]) for c in self.cut]
        self.apart = x[apart], y[apart]
        self.models = [fit_logistic(a, b, l2) for a, b in self.sets]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each view, not calibrated."""
        x = (x - self.mean) / self.spread
        return np.column_stack([sigmoid(x[:, c] @ m[:-1] + m[-1]) for c, m in zip(self.cut, self.models, strict=True)])

    def teach(self, chosen: list[tuple[int, int, bytes]]) -> set[bytes]:
        """Adds rows (view that labels them, label, features) to the other view's set and fits both anew; the rows used."""
        said: list[dict[bytes, int]] = [{}, {}]
        for view, label, data in chosen:
            said[1 - view][data] = label
        # A row that the views disagree about teaches neither.
        clash = {d for d in said[0].keys() & said[1].keys() if said[0][d] != said[1][d]}
        for view in (0, 1):
            rows = sorted((d, v) for d, v in said[view].items() if d not in clash)
            self.taught[view] += len(rows)
            if rows:
                x = (unpacked([d for d, _ in rows]) - self.mean) / self.spread
                held, y = self.sets[view]
                self.sets[view] = np.vstack([held, x[:, self.cut[view]]]), np.append(y, [v for _, v in rows])
        self.models = [fit_logistic(a, b, self.l2) for a, b in self.sets]
        return (said[0].keys() | said[1].keys()) - clash

    def calibrate(self) -> None:
        x, y = self.apart
        raw = np.column_stack([x[:, c] @ m[:-1] + m[-1] for c, m in zip(self.cut, self.models, strict=True)])
        self.platt = [fit_logistic(raw[:, [v]], y, 0.1) for v in (0, 1)]
        self.joint = fit_logistic(self._calibrated(raw), y, 0.1)
        self.sets = self.apart = None  # the models alone go to the executors

    def _calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip(raw[:, v] * p[0] + p[1], -12, 12) for v, p in enumerate(self.platt)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view (both calibrated), combination."""
        if self.models is None:
            return np.full((len(x), 3), self.rate)
        x = (x - self.mean) / self.spread
        z = self._calibrated(np.column_stack([x[:, c] @ m[:-1] + m[-1] for c, m in zip(self.cut, self.models, strict=True)]))
        return np.column_stack([sigmoid(z), sigmoid(z @ self.joint[:-1] + self.joint[-1])])


ALL = WIDTH + SOURCES + LANGS + 3


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f4").reshape(-1, ALL).astype(float)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): both views of every document as 32-bit numbers, one after the other."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            x = [views(hasher, t, s, lang).astype("<f4").tobytes() for t, s, lang in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"))
    return written(rows.mapInArrow(run, "doc_id long, x binary"), "views")


def most_confident(rows: DataFrame, model: CoTrained, used: set[bytes], growth: int, sure: float, pieces: int = 256) -> list[tuple[int, int, bytes]]:
    """(view, label, x): each view's `growth` most confident rows of either label, over the whole table; equal rows count once."""
    shared = rows.sparkSession.sparkContext.broadcast((model, used))  # at most 4 * growth rows for each round before

    def run(batches):
        model, used = shared.value
        best: dict[tuple[int, int], list[tuple[float, bytes]]] = {(view, label): [] for view in (0, 1) for label in (0, 1)}
        for b in batches:
            data = sorted(set(b.column(0).to_pylist()) - used)
            p = model.probabilities(unpacked(data)) if data else np.zeros((0, 2))
            for (view, label), held in best.items():
                q = p[:, view] if label else 1 - p[:, view]
                for i in np.argsort(-q, kind="stable")[: growth + 1].tolist():
                    if q[i] >= sure:
                        held.append((-float(q[i]), data[i]))
                best[view, label] = sorted(set(held))[:growth]
        out = [(view, label, -q, x) for (view, label), held in best.items() for q, x in held]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.binary()))], ["view", "label", "p", "x"])

    found = rows.select("x").mapInArrow(run, "view int, label int, p double, x binary").distinct()
    # Ranked in two levels: what the tasks hand on grows with their number, and one group of it is no task's work.
    kept = found.withColumn("piece", F.pmod(F.xxhash64("x"), F.lit(pieces)))
    for by in (["view", "label", "piece"], ["view", "label"]):
        order = Window.partitionBy(*by).orderBy(F.desc("p"), "x")
        kept = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= growth).drop("n")
    return [(r["view"], r["label"], bytes(r["x"])) for r in kept.select("view", "label", "x").collect()]  # at most 4 * growth rows


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, rounds: int = 4, growth: int = 100, sure: float = 0.95) -> CoTrained:
    """Co-trained models from the table of features and the label table."""
    ids = labelled_ids(labels, [label], per_class).select("doc_id", "y")  # at most 3 * per_class rows
    known = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    known.sort(key=lambda r: r["doc_id"])
    own = [bytes(r["x"]) for r in known]
    model = CoTrained(unpacked(own), np.array([r["y"] for r in known], float))
    if model.models is not None:
        used = set(own)
        for _ in range(rounds):
            used |= model.teach(most_confident(rows, model, used, growth, sure))
        model.calibrate()
    return model


def score(rows: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, page_score, score, keep) of every row of the table of features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two models of under 120 numbers

    def run(batches):
        model = shared.value
        for b in batches:
            p = model.scores(unpacked(b.column(1).to_pylist())) if b.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in p.T), pa.array(p[:, 2] >= threshold)], ["doc_id", "text_score", "page_score", "score", "keep"])

    return rows.mapInArrow(run, "doc_id long, text_score double, page_score double, score double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5) -> DataFrame:
    rows = features(docs)
    return score(rows, train(rows, labels, per_class=per_class), threshold)
