"""Normalisation of one text column: Column -> Column, in built-in expressions.

A `Step` changes a text and counts what it changed. Its count is null where it
changed nothing, so that "absent" and 0 stay apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = ".,;:!?"
#: Characters that show nothing: zero-width space, soft hyphen, marks of direction, byte order mark.
INVISIBLE = "[\\u00AD\\u200B\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]"


@dataclass(frozen=True)
class Step:
    """`change`: the new text. `count`: how much the step changes, from the text before; None counts 1."""

    key: str
    change: Callable[[Column], Column]
    count: Callable[[Column], Column] | None = None

    def counted(self, before: Column, after: Column) -> Column:
        n = self.count(before).cast("long") if self.count else F.lit(1).cast("long")
        return F.when(before != after, n)


def matches(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_count(c, F.lit(pattern))


def replaced(pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, by)


def occurrences(c: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("long")


def strip(c: Column) -> Column:
    """Without leading and trailing white space, also beyond ASCII. Texts that neither begin nor end with it stay, and are not gone through sign by sign."""
    white = lambda v, at: F.substring(v, at, 1).rlike(r"(?U)\s")
    return F.transform(F.array(c), lambda v: F.when(white(v, 1) | white(v, -1), F.regexp_replace(v, r"(?U)^\s+|\s+$", "")).otherwise(v))[0]


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition. ASCII texts, which are composed already, come to Python as nulls."""
    return F.coalesce(_nfc(F.when(F.octet_length(c) > F.length(c), c)), c)


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {3,}", "  ")


def space_before(c: Column) -> Column:
    return F.regexp_replace(c, f" +([{PUNCTUATION}])", "$1")


def space_after(c: Column) -> Column:
    return F.regexp_replace(c, f"([{PUNCTUATION}])([A-Za-z])", "$1 $2")


def three_dots(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\.{3,}", "..."), F.lit("…"), F.lit("..."))


def single_marks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "!{2,}", "!"), r"\?{2,}", "?")


UNICODE = Step("unicode_normalized", nfc, None)
BASIC = [
    Step("spaces_collapsed", collapse_spaces, lambda c: F.regexp_count(c, F.lit("   "))),
    Step("space_before_punct", space_before),
    Step("space_after_punct", space_after),
]
ADVANCED = [Step("ellipsis_normalized", three_dots), Step("punct_collapsed", single_marks)]

SPACED = r"(?U)\b\p{L}(?:(?: |,| ?\. ?)\p{L}){3,}\b"


def join_spaced(c: Column) -> Column:
    """Four or more single letters with a space, comma or full stop between become a word, where they stand."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({SPACED})"), 1), lambda m: F.regexp_replace(m, "[ ,.]", ""))
    between = F.split(c, SPACED, -1)
    return F.array_join(F.zip_with(between, found, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit("")))), "")


TYPOGRAPHY = [
    Step("control_chars_stripped", replaced(INVISIBLE, ""), matches(INVISIBLE)),
    Step("spaced_words_joined", join_spaced, matches(SPACED)),
    Step("hyphens_healed", replaced(r"(\p{L}+)-\n(\p{Ll}+)", "$1$2"), matches(r"(\p{L}+)-\n(\p{Ll}+)")),
    Step("curly_quotes_straightened", lambda c: F.translate(c, "“”‘’", "\"\"''"), matches("[“”‘’]")),
    Step("ellipses_standardized", lambda c: F.replace(c, F.lit("…"), F.lit("...")), matches("…")),
    Step("dashes_normalized", lambda c: F.replace(c, F.lit("–"), F.lit("—")), matches("–")),
]

#: A word of four or more capitals and nothing else; its first sign is looked at before its edges.
LOUD = r"(?=[A-Z]{4})(?<![\p{L}\p{N}_])([A-Z]{4,})(?![\p{L}\p{N}_])"
UNITS = "°C|°F|km|cm|mm|kg|mg|ms|g|m"


def loud_words(c: Column, kept: list[str]) -> Column:
    """array<string>: the words of four or more capitals (and nothing else), but for the kept ones, in order."""
    loud = F.regexp_extract_all(c, F.lit(LOUD), 1)
    return F.filter(loud, lambda w: ~w.isin(kept)) if kept else loud


def deshout(c: Column, kept: list[str]) -> Column:
    """Loud words to lower case, where they stand, in one pass. The kept words are a lexicon of a few, known when the plan is made."""
    quiet = lambda w: F.when(w.isin(kept), w).otherwise(F.lower(w)) if kept else F.lower(w)
    found, between = F.regexp_extract_all(c, F.lit(LOUD), 1), F.split(c, LOUD, -1)
    joined = F.array_join(F.zip_with(between, found, lambda gap, w: F.concat(gap, F.coalesce(quiet(w), F.lit("")))), "")
    return F.when(c.rlike("[A-Z]{4}"), joined).otherwise(c)


def kept_words(lexicon: DataFrame, most: int = 10_000) -> list[str]:
    """The words of a lexicon (word, ...) for de-shouting. It is counted first: beyond `most` words it is refused, as every task holds it."""
    words = [r["word"] for r in lexicon.select("word").where("word is not null").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"a lexicon of more than {most} words")
    return sorted(words)


def shouts(c: Column, kept: list[str]) -> Column:
    return F.size(loud_words(c, kept))


def clock(c: Column) -> Column:
    for letter in "ap":  # a digit is looked for before the edge of a word, which costs more
        c = F.regexp_replace(c, rf"(?i)(?=\d)\b(\d{{1,2}}(?::\d{{2}})?)\s*{letter}\.?m\b\.?", f"$1 {letter}.m.")
    return c


def where_any(signs: str, change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """`change` on texts that have one of the signs; others stay, and are not gone through sign by sign."""

    def changed(v: Column) -> Column:
        there = F.lit(False)
        for sign in signs:
            there = there | v.contains(sign)
        return F.when(there, change(v)).otherwise(v)

    return lambda c: F.transform(F.array(c), changed)[0]


FOOTNOTE = r"(?m)(?<!^)(\[\^?\d+\]|\(\d+\))(?!:)"


def policies(kept: list[str], footnotes: bool = False) -> list[Step]:
    """House style, in order; `footnotes` removes inline footnote marks too."""
    steps = [
        Step("casing_normalized", lambda c: deshout(c, kept), lambda c: shouts(c, kept)),
        Step("runs_collapsed", replaced(r"([!?])\1+", "$1"), matches(r"([!?])\1+")),
        Step("ellipsis", three_dots, matches(r"\.{4,}|…")),
        Step("quotes", where_any("“”‘’", lambda c: F.translate(c, "“”‘’", "\"\"''")), matches("[“”‘’]")),
        Step("percent_joined", where_any("%", replaced(r"(\d)\s+%", "$1%")), matches(r"(\d)\s+%")),
        Step("units", replaced(rf"(\d)\s*({UNITS})(?![A-Za-z])", "$1 $2")),
        Step("times", clock, matches(r"(?i)\b\d{1,2}(?::\d{2})?\s*[ap]\.?m\b\.?")),
        Step("spacing", lambda c: F.regexp_replace(F.regexp_replace(c, " +([!?])", "$1"), r"([.!?]) {2,}(\S)", "$1 $2")),
    ]
    return steps + [Step("footnotes_removed", replaced(FOOTNOTE, ""), matches(FOOTNOTE))] * footnotes
