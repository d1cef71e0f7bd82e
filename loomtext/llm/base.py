"""What several operators of this subpackage share: shared folders, text features, linear models."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of these characters' complement: space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in pieces of this many bytes, so that memory does not follow the longest text.
PIECE = 1 << 17

_ODD = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet into the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes the files of a table from `written` that nothing reads any more: what was made from it is written itself."""
    if df is not None:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_with_hot(many: DataFrame, one: DataFrame, key: str | list[str], n: str, least: int = 10_000) -> DataFrame:
    """Inner join on `key`; `one` has a row for each key, and in `n` how many rows of `many` have it.

    Keys with more than a quarter of a shuffle partition's even share of rows
    (and more than `least`) meet by broadcast, the others by shuffle. Of the
    former there are at most four for each shuffle partition. `one` is computed
    more than once: it should be a written table or a small aggregate.
    """
    most, total = one.agg(F.max(n), F.sum(n)).first()
    limit = max(least, (total or 0) // (4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= limit:
        return many.join(one.drop(n), key)
    hot = F.broadcast(one.where(F.col(n) > limit).drop(n))
    cold = many.join(hot.select(key), key, "left_anti").join(one.where(F.col(n) <= limit).drop(n), key)
    return many.join(hot, key).unionByName(cold)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called like that (Spark ignores case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def char_classes() -> np.ndarray:
    """Byte to lower-case letter byte, or 0 where the byte is no part of a word of letters."""
    lut = np.zeros(256, np.uint64)
    for c in range(256):
        if c >= 0x80 or chr(c).isalpha():
            lut[c] = ord(chr(c).lower()) if c < 0x80 else c
    return lut


class WordHasher:
    """64-bit hashes of the lower-cased letter words of a text, for many words at once.

    With K odd, prefix sums of byte * K^position give every word's polynomial
    after a multiplication by the inverse power of its start.
    """

    def __init__(self) -> None:
        n = PIECE + 1
        self.lut = char_classes()
        self.up = np.ones(n, np.uint64)
        np.multiply.accumulate(np.full(n - 1, _ODD, np.uint64), out=self.up[1:])
        inverse = pow(_ODD, -1, 1 << 64)
        self.down = np.ones(n, np.uint64)
        np.multiply.accumulate(np.full(n - 1, inverse, np.uint64), out=self.down[1:])

    def hashes(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        out, held, size = [], 0, 0  # sum and length of a word that the last piece's end has broken
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            start, end, total = self._words(piece)
            if size:
                goes_on = len(start) > 0 and start[0] == 0
                if goes_on:
                    held = (held + int(total[0]) * pow(_ODD, size, 1 << 64)) % (1 << 64)
                    size += int(end[0])
                    start, end, total, there = start[1:], end[1:], total[1:], int(end[0])
                if not (goes_on and there == len(piece)):
                    out.append(np.array([held], np.uint64))
                    size = 0
            if len(end) and end[-1] == len(piece):
                held, size = int(total[-1]), int(end[-1] - start[-1])
                total = total[:-1]
            out.append(total)
        if size:
            out.append(np.array([held], np.uint64))
        h = np.concatenate(out) if out else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and polynomial sums of the words of one piece."""
        c = self.lut[np.frombuffer(data, np.uint8)]
        inside = np.zeros(len(c) + 2, bool)
        inside[1:-1] = c > 0
        change = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = change[::2], change[1::2]
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(c * self.up[: len(c)], out=total[1:])
        return start, end, (total[end] - total[start]) * self.down[start]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """L2-regularised logistic regression by Newton steps; the last coefficient is the free intercept.

    With one class or no row, the model is the smoothed constant rate.
    """
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return np.append(np.zeros(d), np.log(rate / (1 - rate)))
    a = np.column_stack([x, np.ones(n)]).astype(float)
    w = np.ones(n) if weight is None else weight
    ridge = np.append(np.full(d, l2), 1e-6)
    beta = np.zeros(d + 1)

    def loss(b):
        z = a @ b
        return np.sum(w * (np.logaddexp(0, z) - y * z)) + 0.5 * np.sum(ridge * b * b)

    now = loss(beta)
    for _ in range(rounds):
        p = sigmoid(a @ beta)
        grad = a.T @ (w * (p - y)) + ridge * beta
        curve = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(curve, grad)
        size = 1.0
        while size > 1e-4 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now < 1e-7 * max(1.0, abs(before)):
            break
    return beta


def folds_of(y: np.ndarray, k: int = 5) -> np.ndarray:
    """A fold for each row, every class dealt evenly over the folds."""
    fold = np.empty(len(y), int)
    fold[np.argsort(y, kind="stable")] = np.arange(len(y)) % k
    return fold
