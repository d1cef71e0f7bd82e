import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import substring as S

from .conftest import words


def plain_units(text):
    """Words as (start, end, normalised), and units as (first word, last word), stated without the code under test."""
    words, units, since = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^ \t-\r]+", text)], [], 0
    first = 0
    for n, (_, end, w) in enumerate(words):
        since += 1
        data = w.encode()
        mixed = (data[0] * 31 + data[len(data) // 2] * 131 + data[-1] * 7 + len(data) * 1009) * 0x9E3779B1 % 2**32 >> 16
        stop = n + 1 == len(words) or "\n" in text[end : words[n + 1][0]] or w[-1] in ".!?"
        if stop or (since >= 4 and mixed % 8 == 0):
            units.append((first, n))
            first = n + 1
        since = 0 if stop else since
    return words, units


def plain_runs(text, run_words):
    """(first unit, first word, last word, normalised) of every run."""
    words, units = plain_units(text)
    for i, (a, _) in enumerate(units):
        if (end := next((e for _, e in units[i:] if e - a + 1 >= run_words), None)) is not None:
            yield i, a, end, " ".join(w for *_, w in words[a : end + 1])


def plain_lines(text):
    at = 0
    for n, line in enumerate(text.split("\n")):
        if words := line.lower().split():
            yield n, at, at + len(line), " ".join(words), len(words)
        at += len(line) + 1


def brute(rows, line_words=8, run_words=10, short_words=3):
    """Kept texts by row number, from rows (doc_id, text), by dictionaries of whole strings; none of the module's helpers."""
    first = {}
    text_hash = [(xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 if t is not None else 0 for _, t in rows]  # in the order of signed numbers
    rank = lambda i, n: ((rows[i][0] is not None, rows[i][0] or 0), text_hash[i], n)
    for i, (_, t) in enumerate(rows):
        found = [("run", data, n) for n, _, _, data in plain_runs(t, run_words)] + [("line", data, n) for n, _, _, data, k in plain_lines(t) if k >= short_words] if t is not None else []
        for kind, data, n in found:
            first[kind, data] = min(first.get((kind, data), rank(i, n)), rank(i, n))
    out = []
    for i, (_, t) in enumerate(rows):
        if not t:
            out.append(t)
            continue
        gone, cut, words, seen = set(), set(), plain_units(t)[0], set()
        for n, a, z, data in plain_runs(t, run_words):
            if first["run", data] != rank(i, n):
                cut |= set(range(a, z + 1))
        for k in cut:  # words that go, and what is between two of them
            gone |= set(range(words[k][0], words[k + 1][0] if k + 1 in cut else words[k][1]))
        while more := {k + 1 for k in gone if k + 1 < len(t) and k + 1 not in gone and t[k + 1] in " \t"}:
            gone |= more
        lines = list(plain_lines(t))
        for n, a, z, data, k in lines:
            if data in seen or (k >= short_words and first["line", data] != rank(i, n) and (len(lines) > 1 or k >= line_words)):
                gone |= set(range(a, z))
            seen.add(data)
        # What goes from a line's start to its end takes the line break along.
        ends = [k for k in gone if k + 1 not in gone and t[k + 1 : k + 2] == "\n"]
        held = frozenset(gone)
        for k in ends:
            start = k
            while start - 1 in held:
                start -= 1
            if start == 0 or t[start - 1] == "\n":
                gone.add(k + 1)
        out.append("".join(c for k, c in enumerate(t) if k not in gone))
    return out


def test_units_keep_offsets():
    t = "One two three. Four five!  Six\n\nWhole line here\nlast. "
    u = list(S.units_of(t))
    assert [t[a:b] for a, b, *_ in u] == ["One two three.", "Four five!", "Six", "Whole line here", "last."]
    assert [x[4] for x in u] == [False, False, False, True, False]
    assert u[0][2] == next(S.units_of("ONE   two three."))[2]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    sentence = lambda: " ".join(words(rng, rng.randint(4, 9))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(10))
    common = "this very common line is found in about every single document here"
    rows = []
    for k in range(700):
        body = [" ".join(sentence() for _ in range(4)) for _ in range(2)]
        if k % 7 == 0:
            body[0] += " and so " + passage
        if k % 2 == 0:
            body.append(common)
        if k % 50 == 0:
            body.append("An.")
        rows.append((k, "\n".join(body)))
    return rows, passage, common


def test_passages_and_common_lines(spark, corpus):
    rows, passage, common = corpus
    got = {r["doc_id"]: r for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert [got[d]["text"] for d, _ in rows] == brute(rows)
    inner = passage[passage.index(". ") + 2 :]
    assert inner in got[0]["text"] and not any(inner in got[d]["text"] for d in range(7, 700, 7))
    assert sum(common in r["text"] for r in got.values()) == 1  # over 256 copies: by way of the hot buckets
    for d, t in rows:
        assert sum(s["end"] - s["start"] for s in got[d]["removed"]) <= got[d]["n_removed"]
        assert got[d]["n_removed"] == len(t) - len(got[d]["text"])
        if d % 2 and d % 7:
            assert got[d]["text"] == t  # clean ones stay whole
        assert "An." not in t or got[d]["text"].endswith("An.")


def test_awkward(spark, awkward, nothing):
    out = S.dedup_substrings(awkward)
    assert out.count() == awkward.count() and out.columns[:4] == ["doc_id", "text", "lang", "source"]
    rows = out.collect()
    assert {r["text"] for r in rows if r["doc_id"] == 1} == {None} and {r["text"] for r in rows if r["doc_id"] == 2} == {""}
    assert all(r["text"] == "same text for all" for r in rows if r["doc_id"] in range(7, 14))  # short lines stay
    assert S.dedup_substrings(nothing).count() == 0


def test_copies(spark):
    t = " ".join(f"word{k}" for k in range(30)) + "."
    d = spark.createDataFrame([(3, t), (2, t), (2, t), (9, t)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in S.dedup_substrings(d).select("doc_id", F.col("text")).collect())
    assert got == [(2, t), (2, t), (3, ""), (9, "")]


def test_lines_repeated_within_a_text(spark):
    fresh = "Seven words make up this first line"
    t = f"{fresh}\nietzte.\nAn. Bo.\n\nietzte.\n  IETZTE.\nAn. Bo.\nshort one\n{fresh}\nlast"
    other = "ietzte.\nshort one\nof its own kind"
    d = spark.createDataFrame([(1, t), (2, other), (3, "\n\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.dedup_substrings(d).collect()}
    assert got[1]["text"] == f"{fresh}\nietzte.\nAn. Bo.\n\nshort one\nlast"
    assert got[1]["n_removed"] == len(t) - len(got[1]["text"]) and len(got[1]["removed"]) == 4
    assert got[2]["text"] == other and got[3]["text"] == "\n\n"  # short lines of other texts are no repeats


def test_short_lines_repeated_across_texts(spark):
    three, two_units = "All rights reserved", "One of two units. The other. Es."
    rows = [(k, f"Text {k} begins\n{three}\n{two_units} \nAn.\nand ends with {k}") for k in range(5)] + [(9, three), (10, f"{two_units} One more here now.")]
    got = {r["doc_id"]: r["text"] for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[0] == rows[0][1] and got[9] == three and got[10] == rows[6][1]
    assert all(got[k] == f"Text {k} begins\nAn.\nand ends with {k}" for k in range(1, 5))


def test_nothing_goes_that_is_repeated_nowhere(spark):
    """Short units between repeats, and repeats that stand side by side in no earlier text, stay."""
    rng = random.Random(5)
    a, b, c, d = (" ".join(words(rng, 12)).capitalize() + "." for _ in range(4))
    rows = [(1, f"{a}\nSomething else\n{b}"), (2, f"{a}\nSigned Bob\n{b}"), (3, f"Fresh words here. {c} In between. {d} Last ones."), (4, f"{c} Not in between. {d}"), (5, "Alone. " + a[:-1] + " and on it goes")]
    got = {r["doc_id"]: r["text"] for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)
    assert got[2] == "Signed Bob\n" and got[4] == "Not in between. " and got[5] == rows[4][1]
    # Units of six words each: known from two texts, but as neighbours from none.
    u = [" ".join(words(rng, 6)).capitalize() + "." for _ in range(6)]
    rows = [(1, f"{u[0]} {u[1]} {u[2]}"), (2, f"{u[3]} {u[4]} {u[5]}"), (3, f"Well. {u[1]} {u[4]} {u[0]}"), (4, f"Well so. {u[4]} {u[5]} {u[0]}")]
    got = {r["doc_id"]: r["text"] for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)
    assert got[3] == rows[2][1] and got[4].endswith(f". {u[0]}") and got[4].startswith("Well so. ") and len(got[4]) < len(rows[3][1]) - len(u[4])


def test_brute_force_on_short_random_texts(spark):
    """Few different words, tiny sentences, line breaks, letters beyond ASCII, equal ids: many chance repeats."""
    rng = random.Random(6)
    part = lambda: " ".join(rng.choice(["aé", "Bö", "İc", "d😀", "e"]) + rng.choice(["", "", ".", "!", "x", "y", "z"]) for _ in range(rng.randint(1, 9)))
    parts = [part() for _ in range(30)]
    rows = [(rng.choice([None, *range(150)]), rng.choice([" ", "\n", "  ", " \n\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for _ in range(250)]
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "text", "removed", "n_removed").collect()
    want = sorted(zip((r[0] for r in rows), brute(rows), strict=True), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == want
    assert sum(r["n_removed"] > 0 for r in got) > 60


def test_clashing_names(spark):
    rows = [(1, "One line of some words here", 5, "a", "b", "c"), (2, "One line of some words here\nand another one", 6, "d", "e", "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _key int, UNITS string, doc string, k string")
    got = S.dedup_substrings(d)
    assert got.columns == [*d.columns, "removed", "n_removed"]
    assert sorted(map(tuple, got.select(*d.columns).collect())) == [rows[0], (2, "and another one", 6, "d", "e", "f")]
