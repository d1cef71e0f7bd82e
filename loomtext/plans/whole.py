"""The whole cleaning pipeline, model steps included.

Steps without a model are those of `clean`, and `scrubber`. A model step (`detect`,
`grammar`, `fix`) has two phases with files between them: the documents as they are, a
row each with a number of its own, are written; their different requests are asked, and the answers added to
a folder of files; then the same plan goes on from the documents and the answers. After a failure the
pipeline is run again with the same folder: it goes on from the last documents that were written, and
only requests without a good answer are asked. What came before these documents is removed, so that
the files are those of two steps at most. A folder belongs to one run of one table.

- detect: chunks are asked for replacements; those found in the document form its plan, each pair once, in order.
- apply: the document's plan, first occurrences in order, all edits rejected if a validator fails.
- grammar: the whole text with the plan's first items as hints; an answer shorter than 1.5 times the text counts.
- fix: the whole text again, with 1.2 times; or with `Model.nodes` piece by piece of so many characters,
  with the rewrite guards for each piece, and the document goes back as a whole if its pieces change its length by over `Model.most_growth`.

Defined cases: null texts ask nothing and stay null; documents may share a doc_id or have none; equal requests
are asked once; a request without a good answer changes nothing; an unknown step is left out with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import spans
from loomtext.operators import apply, chunking, inference, requests, responses, scrub
from loomtext.operators.stats import long_stats
from loomtext.plans.clean import STEPS, Options, count_columns

#: The first of these steps are what a run has if none are named.
DEFAULT = ("mask", "detect", "grammar")
PLAN = "array<struct<item_no:int,find:string,replace:string,reason:string>>"
REASONS = ["timeout", "non_response", "forbidden_tokens", "growth_limit", "empty_or_non_text"]


@dataclass
class Model:
    """What answers requests, the prompts by phase, where the run's files are, and how requests are sent."""

    complete: Callable[[dict], str]
    folder: str
    prompts: dict[str, str] = field(default_factory=lambda: {"detect": "Find and fix text problems.", "grammar": "Fix grammar and TTS issues.", "fix": "Perform light polish on the text."})
    pool: inference.Pool = field(default_factory=inference.Pool)
    chunk: int = 600
    hints: int = 20
    nodes: int | None = None
    least_node: int = 20
    most_growth: float = 0.05


def _path(model: Model, name: str):
    """A path below the run's folder, and its file system."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{model.folder}/{name}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def reached(model: Model, steps: tuple[str, ...]) -> int | None:
    """The last model step whose documents are there as a whole."""
    there = []
    for number, name in enumerate(steps):
        if name in ASKING:
            path, files = _path(model, f"{number}-{name}/documents/_SUCCESS")
            there += [number] if files.exists(path) else []
    return max(there, default=None)


def numbered(df: DataFrame, model: Model, step: str) -> DataFrame:
    """The documents as they are before a model step, each row with its number; written if they are not there."""
    folder = f"{model.folder}/{step}/documents"
    path, files = _path(model, f"{step}/documents/_SUCCESS")
    if not files.exists(path):
        rows = df if "_row" in df.columns else df.withColumn("_row", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(folder, compression="zstd")
        root, files = _path(model, "")
        for f in files.listStatus(root):
            if f.getPath().getName() != step:
                files.delete(f.getPath(), True)
    return df.sparkSession.read.parquet(folder)


def said(asked: DataFrame, model: Model, step: str) -> DataFrame:
    """(digest, response, error) to the requests."""
    out = inference.answers(inference.distinct_requests(asked), model.complete, f"{model.folder}/{step}/answers", model.pool)
    return out.select("digest", responses.without_thoughts(F.col("response")).alias("response"), "error")


def counted(df: DataFrame, step: str, **counts: Column) -> DataFrame:
    return df.withColumns({f"{step}.{key}": c.cast("long") for key, c in counts.items()})


def detect(df: DataFrame, o: Options, model: Model, step: str) -> DataFrame:
    d = numbered(df.drop("_plan"), model, step)
    chunks = d.select("_row", F.posexplode(chunking.fixed_width(F.col("text"), model.chunk)).alias("chunk_no", "chunk")).where(F.col("chunk").rlike(chunking.NOT_BLANK))
    asked = inference.keyed(chunks, "detect", F.lit(model.prompts["detect"]), F.col("chunk"))
    own = asked.select("_row", "chunk_no", "digest")
    answers = said(asked, model, step)
    items = responses.parse_lines(answers.where("error is null"), ["digest"])  # each different answer is read once
    # An answer's items and a row of nulls, which counts the answer, so that chunks meet answers once.
    told = items.unionByName(answers.where("error is null").select("digest"), allowMissingColumns=True)
    place = F.struct("chunk_no", "item_no", "reason")
    pairs = own.join(told, "digest").groupBy("_row", "find", "replace").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"))
    item = F.when(F.col("find").isNotNull(), F.struct("at", "find", "replace", "n"))
    found = pairs.groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("_found"), F.sum(F.when(F.col("find").isNull(), F.col("n"))).alias("_calls"))
    d = d.join(found, "_row", "left")
    good = F.filter(F.coalesce("_found", F.expr("cast(array() as array<struct<at:struct<chunk_no:int,item_no:int,reason:string>,find:string,replace:string,n:bigint>>)")), lambda x: F.contains(F.col("text"), x["find"]))
    d = d.withColumn("_good", good)
    many = lambda items: F.aggregate(F.coalesce(items, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    valid = many(F.transform("_good", lambda x: x["n"]))
    d = counted(d, "detect", model_calls=F.coalesce("_calls", F.lit(0)), chunks_processed=F.coalesce("_calls", F.lit(0)), suggestions_valid=valid, suggestions_rejected=many(F.transform("_found", lambda x: x["n"])) - valid, plan_size=F.size("_good"))
    plan = F.transform("_good", lambda x, k: F.struct(k.cast("int").alias("item_no"), x["find"].alias("find"), x["replace"].alias("replace"), x["at"]["reason"].alias("reason")))
    return d.withColumn("_plan", plan.cast(PLAN)).drop("_found", "_good", "_calls")


def apply_own(df: DataFrame, o: Options) -> DataFrame:
    """The plan of each document, from the detect step or from the options."""
    if "_plan" not in df.columns:
        return STEPS["apply"](df, o)
    items = F.transform("_plan", lambda x: F.struct(x["item_no"].alias("item_no"), x["find"].alias("find"), x["replace"].alias("replace")))
    d = apply.apply_items(df.withColumn("_items_of", items), "_items_of", **o.validators)
    done = ~F.col("skipped")
    d = counted(
        d,
        "apply",
        replacements_applied=F.when(done, F.col("replacements_applied")),
        replacements_rejected=F.when(done, F.col("replacements_rejected")),
        validation_passed=F.when(done & F.col("error").isNull(), 1),
        validation_failed=F.when(done & F.col("error").isNotNull(), 1),
        skipped=F.when(~done, 1),
    )
    return d.drop("replacements_applied", "replacements_rejected", "error", "skipped")


def hinted(prompt: str, plan: Column, most: int) -> Column:
    lines = F.transform(F.slice(plan, 1, most), lambda x: F.concat(F.lit('- "'), x["find"], F.lit('" → "'), x["replace"], F.lit('" (reason: '), x["reason"], F.lit(")")))
    return F.when(F.size(plan) > 0, F.concat(F.lit(prompt + requests.HINTS), F.array_join(lines, "\n"), F.lit(requests.TRAILER))).otherwise(F.lit(prompt))


def whole_text(df: DataFrame, model: Model, step: str, phase: str, out: Column, factor: float) -> DataFrame:
    """df with `_said`, the answer for its whole text, and `_fits`, whether it is there and counts. Lengths are taken before the join, so that statistics move no texts."""
    d = numbered(df, model, step)
    system = hinted(model.prompts[phase], F.col("_plan"), model.hints) if phase == "grammar" and "_plan" in d.columns else F.lit(model.prompts[phase])
    asked = inference.keyed(d.select("text", *(c for c in ("_plan",) if c in d.columns)), phase, system, F.col("text"))
    answers = said(asked, model, step).where("error is null").select(F.col("digest").alias("_digest"), out.alias("_said")).withColumn("_m", F.length("_said"))
    d = d.withColumns({"_digest": inference.digest(phase, system, F.col("text")), "_n": F.length("text")}).join(answers, "_digest", "left")
    fits = F.coalesce((F.col("_m") > 0) & (F.col("_m") < factor * F.col("_n")), F.lit(False))
    return d.withColumn("_fits", fits).drop("_digest", "_n", "_m")


def replaced(d: DataFrame) -> DataFrame:
    return d.withColumn("text", F.when(F.col("_fits"), F.col("_said")).otherwise(F.col("text"))).drop("_said", "_fits")


def grammar(df: DataFrame, o: Options, model: Model, step: str) -> DataFrame:
    d = whole_text(df, model, step, "grammar", responses.result_part(F.col("response")), 1.5)
    provided = F.size("_plan") if "_plan" in d.columns else F.lit(0)
    return replaced(counted(d, "grammar", problems_provided=provided, grammar_applied=F.col("_fits").cast("int")))


def fix(df: DataFrame, o: Options, model: Model, step: str) -> DataFrame:
    if model.nodes:
        return fix_nodes(df, model, step)
    d = whole_text(df, model, step, "fix", F.col("response"), 1.2)
    return replaced(counted(d, "fix", polishing_calls=F.col("_fits").cast("int")))


def fix_nodes(df: DataFrame, model: Model, step: str) -> DataFrame:
    """Pieces which joined are the text; white space around a piece stays where it is."""
    d = numbered(df, model, step)
    pieces = d.select("_row", F.posexplode(chunking.split_long(F.col("text"), model.nodes)).alias("node_no", "piece"))
    core = F.regexp_extract("piece", r"(?U)(?s)^(\s*)(.*?)(\s*)$", 2)
    nodes = pieces.withColumn("text", core).withColumn("before", F.regexp_extract("piece", r"(?U)^\s*", 0)).withColumn("after", F.when(F.length("text") > 0, F.regexp_extract("piece", r"(?U)\s*\z", 0)).otherwise(""))
    keyed = inference.keyed(nodes, "fix", F.lit(model.prompts["fix"]), F.when(responses.worth_fixing(F.col("text"), model.least_node), F.col("text")))
    own = keyed.select("_row", "node_no", "before", "text", "after", "digest")
    r = responses.rewritten(own, said(keyed, model, step), ["digest"], least=model.least_node)
    piece = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_no", F.concat("before", c, "after").alias("t")))), lambda x: x["t"]), "")
    rejected = {f"_r_{x}": F.count_if(F.col("reject") == x) for x in REASONS}
    per = r.where(F.length("original") > 0).groupBy("_row").agg(
        F.count(F.lit(1)).alias("_seen"), F.count("fixed").alias("_asked"), F.count_if("fixed").alias("_fixed"), *(c.alias(k) for k, c in rejected.items())
    )
    texts = r.groupBy("_row").agg(piece(F.col("text")).alias("_new"))
    d = d.join(texts.join(per, "_row", "left"), "_row", "left")
    back = F.abs(F.length("_new") - F.length("text")) > model.most_growth * F.length("text")
    d = d.withColumn("_back", F.coalesce(back, F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = counted(d, "fix", nodes_seen=zero(F.col("_seen")), spans_total=zero(F.col("_asked")), spans_fixed=zero(F.col("_fixed")), spans_rejected=zero(F.col("_asked") - F.col("_fixed")), reverted=F.when(F.col("_back"), 1), **{f"rejected_{x}": F.when(F.col(f"_r_{x}") > 0, F.col(f"_r_{x}")) for x in REASONS})
    d = d.withColumn("text", F.when(F.col("_back"), F.col("text")).otherwise(F.coalesce("_new", "text")))
    return d.drop("_new", "_back", "_seen", "_asked", "_fixed", *rejected)


def scrubber(df: DataFrame, o: Options) -> DataFrame:
    d = scrub.scrub(df, **o.scrub)
    return counted(d, "scrubber", blocks_removed=F.col("removed")).drop("removed")


PLAIN: dict[str, Callable[[DataFrame, Options], DataFrame]] = STEPS | {"scrubber": scrubber, "apply": apply_own}
ASKING: dict[str, Callable[[DataFrame, Options, Model, str], DataFrame]] = {"detect": detect, "grammar": grammar, "fix": fix}


def clean_everything(docs: DataFrame, model: Model | None = None, steps: tuple[str, ...] = DEFAULT, options: Options | None = None, keep: list[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(documents with clean text, statistics keep, step, key, value). Model steps need a `model`."""
    df, options = docs, options or Options()
    if model is None and any(name in ASKING for name in steps):
        raise ValueError("these steps need a model")
    begun = reached(model, steps) if model else None
    for number, name in enumerate(steps):
        if begun is not None and number < begun:
            continue  # the documents before step `begun` have what this one does
        if name in ASKING:
            df = ASKING[name](df, options, model, f"{number}-{name}")
        elif name in PLAIN:
            df = PLAIN[name](df, options)
        else:
            warnings.warn(f"unknown step {name}", stacklevel=2)
    if "_masks" in df.columns:
        df = df.withColumn("text", spans.unmasked(F.col("text"), F.col("_masks")))
    df = df.drop("_masks", "_plan", "_row")
    return df.select(*(F.col(f"`{c}`") for c in df.columns if "." not in c)), long_stats(df, count_columns(df), list(keep))
