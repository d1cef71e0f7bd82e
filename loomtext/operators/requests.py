"""Requests to a model, as tables; and their answers, by an injected callable."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.responses import END, START

#: Sampling parameters by phase: temperature, longest answer, repetition penalty.
PARAMS = {"detect": (0.3, 1024, 1.5), "grammar": (0.1, 8192, 1.0), "fix": (0.0, 8192, 1.0)}
#: Where a model stops, and the wording around hints: fixed values of the requests.
STOP = "</RESULT>"
HINTS = "\n\nDETECTED TTS PROBLEMS TO FIX:\n"
TRAILER = "\n\nApply these corrections to make the text more TTS-friendly while fixing any grammar issues."


def requests(chunks: DataFrame, prompts: DataFrame, phase: str, prompt_key: str) -> DataFrame:
    """(doc_id, chunk_no, phase, system, user, temperature, max_tokens, repetition_penalty, stop, enable_thinking); one prompt, which the key names."""
    t, n, r = PARAMS[phase]
    prompt = prompts.where(F.col("key") == prompt_key).select(F.col("prompt").alias("system")).limit(1)
    return chunks.join(F.broadcast(prompt)).select(
        "doc_id",
        "chunk_no",
        F.lit(phase).alias("phase"),
        "system",
        F.concat(F.lit(START + "\n"), "text", F.lit("\n" + END)).alias("user"),
        F.lit(t).alias("temperature"),
        F.lit(n).alias("max_tokens"),
        F.lit(r).alias("repetition_penalty"),
        F.array(F.lit(STOP)).alias("stop"),
        F.lit(False).alias("enable_thinking"),
    )


def hint_lines(plan: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, hints): the first `most` items of each document's plan as one text."""
    item = F.struct("item_no", F.concat(F.lit('- "'), "find", F.lit('" → "'), "replace", F.lit('" (reason: '), "reason", F.lit(")")).alias("line"))
    items = F.slice(F.array_sort(F.collect_list(item)), 1, most)
    return plan.groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("hints"))


def with_hints(requests: DataFrame, plan: DataFrame, most: int = 20) -> DataFrame:
    """Requests whose system text carries the document's detected problems."""
    h = hint_lines(plan, most).withColumnRenamed("doc_id", "_id")
    j = requests.join(h, requests["doc_id"] == h["_id"], "left").drop("_id")
    full = F.concat("system", F.lit(HINTS), "hints", F.lit(TRAILER))
    return j.withColumn("system", F.when(F.col("hints").isNull(), F.col("system")).otherwise(full)).drop("hints")


def with_replacement_map(prompt: Column, pairs: Column, most: int = 100) -> Column:
    """A prompt with the map's first `most` pairs; unchanged if it has none."""
    said = F.array_join(F.transform(F.slice(pairs, 1, most), lambda p: F.concat(F.lit('"'), p["key"], F.lit('" → "'), p["value"], F.lit('"'))), "\n")
    return F.when(F.size(pairs) > 0, F.concat(prompt, F.lit("\n\nPREPASS REPLACEMENTS:\n"), said)).otherwise(prompt)


class Helper:
    """A thread that makes one call after another. One that hangs keeps it, and the next call gets a new thread."""

    def __init__(self) -> None:
        self.todo: queue.SimpleQueue | None = None

    def call(self, seconds: float, complete: Callable[[dict], str], row: dict) -> tuple:
        if self.todo is None:
            self.todo, self.done = queue.SimpleQueue(), queue.SimpleQueue()
            threading.Thread(target=self.work, args=(self.todo, self.done), daemon=True).start()
        self.todo.put((complete, row))
        try:
            return self.done.get(timeout=seconds)
        except queue.Empty:
            self.leave()
            raise TimeoutError(f"timeout after {seconds} s") from None

    @staticmethod
    def work(todo: queue.SimpleQueue, done: queue.SimpleQueue) -> None:
        while (job := todo.get()) is not None:
            complete, row = job
            try:
                done.put((complete(row), None))
            except Exception as e:  # goes to the caller
                done.put((None, e))

    def leave(self) -> None:
        if self.todo is not None:
            self.todo.put(None)
            self.todo = None

    def __del__(self) -> None:  # the thread it helps has ended
        self.leave()


_OWN = threading.local()


def within(seconds: float | None, complete: Callable[[dict], str], row: dict) -> str:
    """complete(row), or a TimeoutError after so many seconds; the call that hangs is left to itself."""
    if seconds is None:
        return complete(row)
    if not hasattr(_OWN, "helper"):
        _OWN.helper = Helper()
    said, error = _OWN.helper.call(seconds, complete, row)
    if error:
        raise error
    return said


def answered(requests: DataFrame, complete: Callable[[dict], str], tries: int = 2, at_once: int | None = None, seconds: float | None = None) -> DataFrame:
    """(doc_id, chunk_no, phase, response, error): `complete` called for each request row; a failing one gets its error.

    `at_once` is the number of partitions, and so of calls under way together;
    `seconds` limits each call.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                response, error = None, None
                for _ in range(tries):
                    try:
                        response, error = within(seconds, complete, row), None
                        break
                    except Exception as e:  # whatever the model's client raises is this request's result
                        error = f"{type(e).__name__}: {e}"
                out.append((row["doc_id"], row["chunk_no"], row["phase"], response, error))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "phase", "response", "error"])

    spread = requests.repartition(at_once) if at_once else requests
    return spread.mapInPandas(run, "doc_id long, chunk_no int, phase string, response string, error string")


def stored_answers(requests: DataFrame, complete: Callable[[dict], str], path: str, **options) -> DataFrame:
    """Answers from the folder `path`, to which those of requests without a good one there are added first.

    Run again after a failure, it asks only for what is missing. Of several
    answers to a request a good one counts, else the last error by name.
    """
    spark = requests.sparkSession
    schema = "doc_id long, chunk_no int, phase string, response string, error string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    answered(unanswered(requests, spark.read.schema(schema).parquet(path)), complete, **options).write.mode("append").parquet(path)
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), F.col("response"), F.col("error")))
    rows = spark.read.schema(schema).parquet(path).groupBy("doc_id", "chunk_no", "phase").agg(best.alias("a"))
    return rows.select("doc_id", "chunk_no", "phase", "a.response", "a.error")


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests without a good answer yet: what a resumed run sends."""
    done = responses.where("error is null").select("doc_id", "chunk_no", "phase")
    return requests.join(done, ["doc_id", "chunk_no", "phase"], "left_anti")
