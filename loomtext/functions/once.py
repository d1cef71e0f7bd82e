"""Evaluating an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each evaluated once for each row.

    Projections that follow each other are merged, and a costly expression that
    is used in several places is then evaluated in each. A one-row generator
    between them keeps its result.
    """
    values = F.struct(*(c.alias(name) for name, c in columns.items()))
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", F.explode(F.array(values)).alias("_once")).select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_once.{name}").alias(name) for name in columns))


#: Folds that collect work on so many elements at a time.
BLOCK = 256


def blocks(items: Column) -> Column:
    """The array in pieces of BLOCK elements; an empty one is one empty piece."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def collected(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: what `step` gives out, element by element, as (next state, array of none or one).

    An array that grows by one is copied each time. Here only a block's own part is, and
    the parts once for each block, so that a long array takes linear time, or nearly so.
    """
    none, nothing = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def add(s: Column, x: Column) -> Column:
        after, out = step(s["state"], x)
        return F.struct(after.alias("state"), F.concat(s["out"], out).alias("out"))

    def over(s: Column, block: Column) -> Column:
        part = F.aggregate(block, F.struct(s["state"].alias("state"), none.alias("out")), add)
        return F.transform(F.array(part), lambda r: F.struct(r["state"].alias("state"), F.concat(s["done"], F.array(r["out"])).alias("done")))[0]

    # The array is a variable of a one-element transformation, so that it is worked out once and not for each block.
    whole = lambda own: F.aggregate(blocks(own), F.struct(state.alias("state"), nothing.alias("done")), over, lambda s: F.flatten(s["done"]))
    return F.transform(F.array(items), whole)[0]
