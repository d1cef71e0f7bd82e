"""Text steps, validators and spans on small inputs, against plain Python or stated results."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import spans, text, validators


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("step", "before", "after", "count"),
    [
        (text.BASIC[0], "a    b   c  d", "a  b  c  d", 2),
        (text.BASIC[1], "word ,next  !", "word,next!", 1),
        (text.BASIC[2], "a,b example.com", "a, b example. com", 1),
        (text.ADVANCED[0], "a..... b… c..", "a... b... c..", 1),
        (text.ADVANCED[1], "no!!! what??? !?!?", "no! what? !?!?", 1),
        (text.TYPOGRAPHY[0], "z​w­x‭y﻿", "zwxy", 4),
        (text.TYPOGRAPHY[1], "S p a c e d and A,n,o,t,h,e,r\na b c", "Spaced and Another\na b c", 2),
        (text.TYPOGRAPHY[2], "crea-\ntive state-of-the-art", "creative state-of-the-art", 1),
        (text.TYPOGRAPHY[3], "“a” ‘b’", "\"a\" 'b'", 4),
        (text.TYPOGRAPHY[4], "x…", "x...", 1),
        (text.TYPOGRAPHY[5], "a – b — c", "a — b — c", 1),
    ],
)
def test_steps(spark, step, before, after, count):
    assert one(spark, before, step.change) == after
    assert one(spark, before, lambda c: step.counted(c, step.change(c))) == count
    assert one(spark, after, lambda c: step.counted(c, step.change(c))) is None


@pytest.mark.parametrize(
    ("key", "before", "after"),
    [
        ("casing_normalized", "MAGNIFICENT NASA BLUH Þór ABC", "magnificent NASA BLUH Þór ABC"),
        ("runs_collapsed", "??!! !!!!!", "?! !"),
        ("percent_joined", "95 % of", "95% of"),
        ("units", "23   °C and 5km", "23 °C and 5 km"),
        ("times", "9am, 12 PM 8:30am", "9 a.m., 12 p.m. 8:30 a.m."),
        ("spacing", "this  ? One.  Two", "this? One. Two"),
        ("footnotes_removed", "word[^1] and[2] too (3)\n[^1]: note", "word and too \n[^1]: note"),
    ],
)
def test_policies(spark, key, before, after):
    step = next(s for s in text.policies(["NASA", "BLUH"], footnotes=True) if s.key == key)
    assert one(spark, before, step.change) == after
    assert one(spark, after, step.change) == after


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("a b c d. Ba b c d", "abcd. Ba b c d"),
        ("x a b c d y", "xabcdy"),
        ("S. p. a. c e d, n,o,w", "Spaced, n,o,w"),
        ("a b c", "a b c"),
        ("", ""),
        (None, None),
        ("é ü ö ß x1", "éüöß x1"),
        ("w o r d\nw o r d", "word\nword"),
    ],
)
def test_letters_are_joined_where_they_stand(spark, before, after):
    assert one(spark, before, text.join_spaced) == after


def test_nfc(spark):
    assert one(spark, "café", text.nfc) == "café"
    assert one(spark, None, text.nfc) is None
    assert one(spark, "plain", text.nfc) == "plain"


def checks(spark, a, b, **options):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        validators.first_failure(F.col("a"), F.col("b"), **options).alias("first"), validators.all_failures(F.col("a"), F.col("b"), **options).alias("all")
    )
    return row.first()


@pytest.mark.parametrize(
    ("a", "b", "names"),
    [
        ("same", "same", []),
        ("x __MASKED_0__ y", "x y", ["Mask Parity"]),
        ("__MASKED_0__ __MASKED_1__", "__MASKED_0__ __MASKED_2__", ["Mask Parity"]),
        ("a `b`", "a b`", ["Backtick Parity"]),
        ("[a](b)", "a", ["Bracket Balance", "Link Sanity"]),
        ("plain text of some length " * 9, "plain *text of some length " + "plain text of some length " * 8, ["Markdown Token Guard"]),
        ("x" * 100, "x" * 150, ["Length Delta Budget"]),
        ("x" * 1000, "x" * 1010, []),
        ("", "anything", []),
        ("long text", "short", []),
    ],
)
def test_validators(spark, a, b, names):
    r = checks(spark, a, b)
    assert r["all"] == names
    assert (r["first"] is None) == (not names)


def test_validator_messages_and_options(spark):
    assert checks(spark, "x" * 100, "x" * 150)["first"] == "Length delta violation: growth 50.0% > 1.0%"
    assert checks(spark, "`", "")["first"] == "Backtick parity violation: 1 → 0"
    assert checks(spark, "`", "", off=("Backtick Parity",))["first"] is None
    twice, swapped = "__MASKED_0__ __MASKED_0__ __MASKED_1__", "__MASKED_0__ __MASKED_1__ __MASKED_1__"
    assert checks(spark, twice, swapped)["all"] == []
    assert checks(spark, twice, swapped, strict=True)["all"] == ["Mask Parity"]


@pytest.mark.parametrize(
    ("a", "b", "reason"),
    [
        ("some text", "some texts", None),
        ("some text", "some *text", "forbidden_tokens"),
        ("some text", "", "empty_or_non_text"),
        ("some text", None, "empty_or_non_text"),
        ("some text", "some text " * 3, "growth_limit"),
        ("some text", "so", "growth_limit"),
        ("", "x", "growth_limit"),
    ],
)
def test_rewrite_guards(spark, a, b, reason):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(validators.rewrite_reason(F.col("a"), F.col("b")), validators.accepted(F.col("a"), F.col("b"))).first()
    assert r[0] == reason
    assert r[1] == (b if reason is None else a)


#: Texts, and by hand the spans that stay in them, in order.
TEXTS = [
    ("", []),
    ("no spans here", []),
    # Four dollar signs and two more: the pairs found one after the other overlap the block, so that $x$ is none.
    (
        "a `code` and ``more `` [t](u) ![](i) ![alt](j) <div>x</div> $$m$$ $x$ \\$5 tail",
        [("INLINE_CODE", "`code`"), ("INLINE_CODE", "``more ``"), ("LINK_URL", "u"), ("IMAGE_URL", "i"), ("LINK_URL", "j"), ("HTML_BLOCK", "<div>x</div>"), ("MATH_BLOCK", "$$m$$")],
    ),
    ("```py\nx = 1\n```\n~~~\ny\n~~~\nend [a](b)(c)", [("CODE_FENCE", "```py\nx = 1\n```"), ("CODE_FENCE", "~~~\ny\n~~~"), ("LINK_URL", "b")]),
    ("```c++\nx\n```\n", [("INLINE_CODE", "```c++\nx\n```")]),
    ("<DIV>a<div>b</div></div> <table>\n</table>", [("HTML_BLOCK", "<DIV>a<div>b</div>"), ("HTML_BLOCK", "<table>\n</table>")]),
    ("é😀 `ü` [ß](ö) $a$ $b$ $c", [("INLINE_CODE", "`ü`"), ("LINK_URL", "ö"), ("INLINE_MATH", "$a$"), ("INLINE_MATH", "$b$")]),
    ("[a](b)[c](d)`x`$y$", [("LINK_URL", "b"), ("LINK_URL", "d"), ("INLINE_CODE", "`x`"), ("INLINE_MATH", "$y$")]),
    ("__MASKED_0__ and `x`", [("INLINE_CODE", "`x`")]),
]


def placed(t, want):
    """The spans with their places: each stands behind the one before, a target in its parentheses."""
    out, at = [], 0
    for kind, part in want:
        target = kind in ("LINK_URL", "IMAGE_URL")
        start = t.index(f"({part})", at) + 1 if target else t.index(part, at)
        at = start + len(part)
        out.append((start, at, kind, part))
    return out


def test_more_kinds(spark):
    t = "---\ntitle: x\n---\nsee <https://a.b/c> and <http://d>"
    got = spark.createDataFrame([(t,)], "t string").select(spans.spans(F.col("t"), extra=True).alias("s"), spans.spans(F.col("t")).alias("n")).first()
    assert [(x["type"], x["text"]) for x in got["s"]] == [("FRONT_MATTER", "---\ntitle: x\n---\n"), ("AUTOLINK", "<https://a.b/c>"), ("AUTOLINK", "<http://d>")] and got["n"] == []


def test_spans_mask_and_nodes(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, t string")
    s, t = spans.spans(F.col("t")), F.col("t")
    rows = d.select("i", "t", s.alias("s"), spans.masked(t, s).alias("m"), spans.unmasked(spans.masked(t, s), spans.mask_table(s)).alias("u"), spans.text_nodes(t, s).alias("n"), spans.outside(t, s, F.upper).alias("up"))
    for r in rows.collect():
        want = placed(*TEXTS[r["i"]])
        assert [tuple(x) for x in r["s"]] == want
        if "__MASKED_" not in r["t"]:
            assert r["u"] == r["t"]
        assert "__MASKED_0__" in r["m"] or not want
        gaps, at = [], 0
        for a, b in [*((w[0], w[1]) for w in want), (len(r["t"]), None)]:
            gaps.append((at, a, r["t"][at:a]))
            at = b
        assert [tuple(x) for x in r["n"]] == [g for g in gaps if g[2].strip()]
        rest, at = "", 0
        for a, b, *_ in want:
            rest += r["t"][at:a].upper() + r["t"][a:b]
            at = b
        assert r["up"] == rest + r["t"][at:].upper()
