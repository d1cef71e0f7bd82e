"""Checks of an edited text against its original: each gives an error, or null where the edit is sound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import occurrences, strip

Check = Callable[[Column, Column], Column]
# Names and wording of the checks' errors are fixed values.
MASK = r"(?U)(__MASKED_\d+__)"
MARKDOWN = "*_[]()<>`~"


def masks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MASK), 1)


def _same(token: str, error: Callable[[Column, Column], Column]) -> Check:
    def check(a: Column, b: Column) -> Column:
        m, n = occurrences(a, token), occurrences(b, token)
        return F.when(m != n, error(m, n))

    return check


def mask_parity(a: Column, b: Column) -> Column:
    m, n = masks(a), masks(b)
    count = F.concat(F.lit("Mask parity violation: "), F.size(m), F.lit(" → "), F.size(n), F.lit(" masks"))
    same = F.array_sort(F.array_distinct(m)) == F.array_sort(F.array_distinct(n))
    return F.when(F.size(m) != F.size(n), count).when(~same, F.lit("Mask parity violation: mask IDs changed"))


def mask_counts(a: Column, b: Column) -> Column:
    """Stricter than mask_parity: every id as often as before."""
    return F.when(F.array_sort(masks(a)) != F.array_sort(masks(b)), F.lit("Mask parity violation: mask counts changed"))


backtick_parity = _same("`", lambda m, n: F.concat(F.lit("Backtick parity violation: "), m, F.lit(" → "), n))
link_sanity = _same("](", lambda m, n: F.concat(F.lit("Link sanity violation: ]( count "), m, F.lit(" → "), n))
fence_parity = _same("```", lambda m, n: F.concat(F.lit("Fence parity violation: ``` count "), m, F.lit(" → "), n))


def signs(a: Column, b: Column, kept: str, check: Check) -> Column:
    """check on both texts without all characters but the kept ones, worked out once; a text is read once and not for each sign."""
    others = "[^" + "".join("\\" + c for c in kept) + "]+"
    both = F.struct(F.regexp_replace(a, others, "").alias("a"), F.regexp_replace(b, others, "").alias("b"))
    return F.transform(F.array(both), lambda x: check(x["a"], x["b"]))[0]


def bracket_balance(a: Column, b: Column) -> Column:
    each = [_same(c, lambda m, n, c=c: F.lit(f"Bracket balance violation: {c} count changed")) for c in "[](){}"]
    return signs(a, b, "[](){}", lambda x, y: F.coalesce(*(c(x, y) for c in each)))


def brackets_unbalanced(a: Column, b: Column) -> Column:
    """Stricter: the edited text opens and closes each bracket equally often."""
    odd = lambda _, y: F.coalesce(*(F.when(occurrences(y, o) != occurrences(y, c), F.lit(f"Bracket balance violation: {o}{c} became unbalanced")) for o, c in ("[]", "()", "{}")))
    return signs(b, b, "[](){}", odd)


def fence_odd(a: Column, b: Column) -> Column:
    return F.when(occurrences(b, "```") % 2 == 1, F.lit("Fence parity violation: odd number of ```"))


def token_guard(a: Column, b: Column) -> Column:
    more = lambda x, y: F.coalesce(*(F.when(occurrences(y, t) > occurrences(x, t), F.lit(f"Token guard violation: new '{t}' tokens introduced")) for t in MARKDOWN))
    return signs(a, b, MARKDOWN, more)


def length_delta(max_ratio: float = 0.01) -> Check:
    def check(a: Column, b: Column) -> Column:
        ratio = (F.length(b) - F.length(a)) / F.length(a)
        said = F.concat(F.lit("Length delta violation: growth "), F.format_string("%.1f", ratio * 100), F.lit(f"% > {max_ratio * 100:.1f}%"))
        return F.when((F.length(a) > 0) & (ratio > max_ratio), said)

    return check


def validators(max_ratio: float = 0.01, off: tuple[str, ...] = (), strict: bool = False) -> dict[str, Check]:
    """The checks by name, in the order in which the first failure counts."""
    checks: dict[str, Check] = {
        "Mask Parity": mask_parity,
        "Backtick Parity": backtick_parity,
        "Bracket Balance": bracket_balance,
        "Link Sanity": link_sanity,
        "Fence Parity": fence_parity,
        "Markdown Token Guard": token_guard,
        "Length Delta Budget": length_delta(max_ratio),
    }
    if strict:
        more = {"Mask Parity": mask_counts, "Bracket Balance": brackets_unbalanced, "Fence Parity": fence_odd}
        for name, extra in more.items():
            checks[name] = lambda a, b, first=checks[name], extra=extra: F.coalesce(first(a, b), extra(a, b))
    return {name: c for name, c in checks.items() if name not in off}


def first_failure(a: Column, b: Column, **options) -> Column:
    """The first failing check's error, or null. A text that stays as it is passes all but the strict checks, and is not gone through."""
    failure = F.coalesce(*(c(a, b) for c in validators(**options).values()))
    return failure if options.get("strict") or options.get("max_ratio", 0) < 0 else F.when(~a.eqNullSafe(b), failure)


def first_failed(a: Column, b: Column, **options) -> Column:
    """The first failing check's name, or null."""
    return F.coalesce(*(F.when(c(a, b).isNotNull(), F.lit(name)) for name, c in validators(**options).items()))


def all_failures(a: Column, b: Column, **options) -> Column:
    """Names of all failing checks."""
    return F.array_compact(F.array(*(F.when(c(a, b).isNotNull(), F.lit(name)) for name, c in validators(**options).items())))


def grammar_structure(table: Column, b: Column, original: Column) -> Column:
    """Every mask of the mask table still there, brackets and backticks as before."""
    lost = F.size(F.array_except(F.map_keys(table), masks(b))) > 0
    return F.when(lost, F.lit("mask lost")).otherwise(F.coalesce(bracket_balance(original, b), backtick_parity(original, b)))


FORBIDDEN = r"https?://|</?[A-Za-z][^>]*>|[`*_\[\]<>~]"


def rewrite_reason(original: Column, out: Column, growth: float = 0.2, shrink: float = 0.5, tokens: bool = True) -> Column:
    """Why a rewritten span is refused: forbidden_tokens (unless `tokens` is off), growth_limit or empty_or_non_text; null accepts it."""
    a, b = F.length(strip(original)), F.length(strip(out))
    new = F.regexp_count(out, F.lit(FORBIDDEN)) > F.regexp_count(original, F.lit(FORBIDDEN)) if tokens else F.lit(False)
    return (
        F.when(out.isNull() | (b == 0), F.lit("empty_or_non_text"))
        .when(new, F.lit("forbidden_tokens"))
        .when((a == 0) | (b > a * (1 + growth)) | (b < a * (1 - shrink)), F.lit("growth_limit"))
    )


def accepted(original: Column, out: Column, **options) -> Column:
    """The trimmed rewrite where it is accepted, else the original."""
    return F.when(rewrite_reason(original, out, **options).isNull(), strip(out)).otherwise(original)


def validated(original: Column, out: Column, **options) -> Column:
    """struct<valid, text, reason>: whether a rewrite is accepted, the trimmed rewrite or the original, and why not (empty if it is)."""
    reason = rewrite_reason(original, out, **options)
    return F.struct(reason.isNull().alias("valid"), F.when(reason.isNull(), strip(out)).otherwise(original).alias("text"), F.coalesce(reason, F.lit("")).alias("reason"))


def sane_length(original: Column, out: Column, factor: float = 1.5) -> Column:
    """A rewrite counts if it isn't empty and stays under factor times the original's length."""
    return F.coalesce((F.length(out) > 0) & (F.length(out) < F.length(original) * factor), F.lit(False))
