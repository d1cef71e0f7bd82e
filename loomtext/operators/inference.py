"""Model calls at scale: equal requests asked once, a bounded pool of calls in each task, waits that grow, answers in files."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.requests import PARAMS, STOP, within
from loomtext.operators.responses import END, START

ANSWERS = "digest string, response string, error string, calls int"


@dataclass(frozen=True)
class Pool:
    """How requests are sent.

    `under_way` calls at once in each task, of which there are `tasks` (as many as the
    session's default parallelism, if not given). A failing call is tried `tries` times in all, after
    `wait` seconds, twice as many before each further try, `longest` at most. `seconds` limits a call, `a_second` the
    calls a second over all tasks. Answers are stored in `waves` steps: a lost job loses the current one at most.
    """

    under_way: int = 8
    tasks: int | None = None
    tries: int = 2
    wait: float = 1.0
    longest: float = 60.0
    seconds: float | None = 600.0
    a_second: float | None = None
    waves: int = 1


def _user(text: Column) -> Column:
    return F.concat(F.lit(START + "\n"), text, F.lit("\n" + END))


def digest(phase: str, system: Column, text: Column) -> Column:
    """The 128-bit key of a request; a null text has none."""
    return F.when(text.isNotNull(), F.md5(F.concat_ws("\u0000", F.lit(phase), system, _user(text))))


def keyed(rows: DataFrame, phase: str, system: Column, text: Column) -> DataFrame:
    """rows with the request's columns and `digest`, its 128-bit key: equal requests have one. A null text has none."""
    t, n, r = PARAMS[phase]
    d = rows.withColumns({"phase": F.lit(phase), "system": system, "user": _user(text), "digest": digest(phase, system, text)})
    return d.withColumns({"temperature": F.lit(t), "max_tokens": F.lit(n), "repetition_penalty": F.lit(r), "stop": F.array(F.lit(STOP)), "enable_thinking": F.lit(False)})


REQUEST = ["digest", "phase", "system", "user", "temperature", "max_tokens", "repetition_penalty", "stop", "enable_thinking"]


def distinct_requests(keyed_rows: DataFrame) -> DataFrame:
    """One row for each different request; copies are combined before the shuffle."""
    return keyed_rows.where("digest is not null").select(*REQUEST).dropDuplicates(["digest"])


class Gate:
    """Lets calls of one task through so many seconds apart."""

    def __init__(self, apart: float) -> None:
        self.apart, self.next, self.lock = apart, 0.0, threading.Lock()

    def enter(self) -> None:
        if self.apart:
            with self.lock:
                now = time.monotonic()
                at = self.next = max(now, self.next + self.apart)
            time.sleep(max(0.0, at - now))


def patiently(row: dict, complete: Callable[[dict], str], pool: Pool, gate: Gate) -> tuple:
    """(digest, response, error, calls) of one request."""
    error = None
    for k in range(pool.tries):
        if k:
            time.sleep(min(pool.longest, pool.wait * 2 ** (k - 1)))
        gate.enter()
        try:
            return row["digest"], within(pool.seconds, complete, row), None, k + 1
        except Exception as e:  # whatever the model's client raises is this request's result
            error = f"{type(e).__name__}: {e}"
    return row["digest"], None, error, pool.tries


def called(requests: DataFrame, complete: Callable[[dict], str], pool: Pool) -> DataFrame:
    """ANSWERS: `complete` called for each request. A task holds `under_way` calls and twice as many requests and answers."""
    tasks = pool.tasks or requests.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(tasks / pool.a_second if pool.a_second else 0.0)
        rows = (row for b in batches for row in b.to_pylist())
        under_way: deque = deque()

        def out(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["digest", "response", "error", "calls"])

        with ThreadPoolExecutor(pool.under_way) as threads:
            done: list[tuple] = []
            for row in rows:
                under_way.append(threads.submit(patiently, row, complete, pool, gate))
                if len(under_way) >= 2 * pool.under_way:
                    done.append(under_way.popleft().result())
                if len(done) >= 100:
                    yield out(done)
                    done = []
            yield out(done + [u.result() for u in under_way])

    return requests.repartition(tasks).mapInArrow(run, ANSWERS)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(folder)


def _ask(requests: DataFrame, complete: Callable[[dict], str], folder: str, pool: Pool) -> bool:
    """Adds answers to distinct requests without a good one in `folder`; whether it had none at all, so that now each request has one row there."""
    spark = requests.sparkSession
    spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in ANSWERS.split(", ")))).write.mode("append").parquet(folder)
    new = _stored(spark, folder).isEmpty()
    for wave in range(pool.waves):
        own = requests.where(F.pmod(F.xxhash64("digest"), F.lit(pool.waves)) == wave) if pool.waves > 1 else requests
        missing = own if new else own.join(_stored(spark, folder).where("error is null").select("digest"), "digest", "left_anti")
        called(missing, complete, pool).write.mode("append").parquet(folder)
    return new


def _best(stored: DataFrame) -> DataFrame:
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "response", "error"))
    return stored.groupBy("digest").agg(best.alias("a"), F.sum("calls").cast("int").alias("calls")).select("digest", "a.response", "a.error", "calls")


def answers(requests: DataFrame, complete: Callable[[dict], str], folder: str, pool: Pool = Pool()) -> DataFrame:
    """ANSWERS of distinct requests, from the files of `folder`, to which those without a good answer there are added first.

    Run again after a failure, only what is missing is asked for. Of several answers
    to a request a good one counts, else the least error by name; `calls` is the sum of all.
    """
    new = _ask(requests, complete, folder, pool)
    stored = _stored(requests.sparkSession, folder)
    return stored if new else _best(stored)
