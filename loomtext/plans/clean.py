"""The cleaning pipeline: named steps in order, as one lazy plan without a shuffle until a step needs one."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import spans, text
from loomtext.functions.once import once
from loomtext.operators.apply import apply_plan
from loomtext.operators.stats import long_stats


@dataclass
class Options:
    """What steps may take: the words de-shouting keeps, whether policies are on, a plan for `apply`, and the validators' and the scrubber's options."""

    kept_words: list[str] = field(default_factory=list)
    policies: bool = True
    footnotes: bool = False
    plan: DataFrame | None = None
    validators: dict = field(default_factory=dict)
    scrub: dict = field(default_factory=dict)


def stepped(df: DataFrame, name: str, steps: list[text.Step]) -> DataFrame:
    """df with `text` after the steps and one count column `name.key` for each; a projection for each step."""
    for s in steps:
        df = df.withColumn("_after", s.change(F.col("text")))
        df = df.withColumn(f"{name}.{s.key}", s.counted(F.col("text"), F.col("_after"))).drop("text").withColumnRenamed("_after", "text")
    return df


def _composed(df: DataFrame, name: str) -> DataFrame:
    df = df.withColumn("_after", text.nfc(F.col("text")))
    changed = F.when(F.col("_after") != F.col("text"), (F.length("text") - F.length("_after")).cast("long"))
    return df.withColumn(f"{name}.unicode_normalized", changed).drop("text").withColumnRenamed("_after", "text")


def mask(df: DataFrame, o: Options) -> DataFrame:
    df = once(df, _spans=spans.spans(F.col("text")))
    df = df.withColumn("_masks", spans.mask_table(F.col("_spans"))).withColumn("mask.masks_created", F.size("_spans").cast("long"))
    return df.withColumn("text", spans.masked(F.col("text"), F.col("_spans"))).drop("_spans")


def _apply(df: DataFrame, o: Options) -> DataFrame:
    if o.plan is None:
        return df.withColumn("apply.skipped", F.lit(1).cast("long"))
    d = apply_plan(df, o.plan, **o.validators)
    failed = F.when(F.col("error").isNotNull(), F.lit(1).cast("long"))
    d = d.withColumn("apply.validation_failed", failed).withColumn("apply.skipped", F.when(F.col("skipped"), F.lit(1).cast("long")))
    return d.withColumnRenamed("replacements_applied", "apply.replacements_applied").withColumnRenamed("replacements_rejected", "apply.replacements_rejected").drop("error", "skipped")


def _policies(df: DataFrame, o: Options) -> DataFrame:
    if not o.policies:  # switched off: texts stay, and every document says so
        return df.withColumn("policies.prepass_advanced_disabled", F.lit(1).cast("long"))
    return stepped(df, "policies", text.policies(o.kept_words, o.footnotes))


STEPS: dict[str, Callable[[DataFrame, Options], DataFrame]] = {
    "mask": mask,
    "prepass-basic": lambda df, o: stepped(_composed(df, "prepass-basic"), "prepass-basic", text.BASIC),
    "prepass-advanced": lambda df, o: stepped(df, "prepass-advanced", text.ADVANCED),
    "typography": lambda df, o: stepped(df, "typography", text.TYPOGRAPHY),
    "policies": _policies,
    "apply": _apply,
}
DEFAULT = ("mask", "prepass-basic", "prepass-advanced")


def cleaned(docs: DataFrame, steps: tuple[str, ...] = DEFAULT, options: Options | None = None) -> DataFrame:
    """docs with the clean text and one nullable count column `step.key` for each count. An unknown step is left out with a warning."""
    df, options = docs, options or Options()
    for name in steps:
        if name not in STEPS:
            warnings.warn(f"unknown step {name}", stacklevel=2)
            continue
        df = STEPS[name](df, options)
    if "_masks" in df.columns:
        df = df.withColumn("text", spans.unmasked(F.col("text"), F.col("_masks"))).drop("_masks")
    return df


def count_columns(df: DataFrame) -> dict[str, dict[str, Column]]:
    out: dict[str, dict[str, Column]] = {}
    for c in df.columns:
        step, dot, key = c.partition(".")
        if dot:
            out.setdefault(step, {})[key] = F.col(f"`{c}`")
    return out


def clean(docs: DataFrame, steps: tuple[str, ...] = DEFAULT, options: Options | None = None, keep: list[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(documents with clean text, statistics keep, step, key, value), both lazy and map-only (but for `apply`)."""
    df = cleaned(docs, steps, options)
    stats = long_stats(df, count_columns(df), list(keep))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if "." not in c)), stats
