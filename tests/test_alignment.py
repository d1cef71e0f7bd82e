import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import alignment


def table(a, b):
    """Longest common subsequence and edit distance, cell by cell."""
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    apart = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            common[i][j] = common[i - 1][j - 1] + 1 if x == y else max(common[i - 1][j], common[i][j - 1])
            apart[i][j] = min(apart[i - 1][j - 1] + (x != y), apart[i - 1][j] + 1, apart[i][j - 1] + 1)
    return common[-1][-1], apart[-1][-1]


def random_pairs(n=150, letters="abé你"):
    rng = random.Random(4)
    for _ in range(n):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 8)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = [rng.choice(letters)] * rng.randint(0, 2)
        yield a, "".join(b)


@pytest.mark.parametrize("width", [None, 8])
def test_lengths_and_distances(monkeypatch, width):
    if width:  # many blocks of few columns
        whole = alignment.blocks
        monkeypatch.setattr(alignment, "blocks", lambda b: (x for at in range(0, len(b), width) for x in whole(b[at : at + width])))
    for a, b in random_pairs():
        assert (alignment.common_length(a, b), alignment.edit_distance(a, b)) == table(a, b)


def test_long_texts_take_words_not_characters_squared():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    b = "x" + a[:30_000] + "yy" + a[30_000:-5] + "zzzz"
    assert alignment.common_length(a, b) >= 59_995
    assert alignment.edit_distance(a, b) <= 8
    assert alignment.edit_distance(a, a) == 0 and alignment.common_length("", a) == 0 and alignment.edit_distance("", "ab") == 2


def test_scripts_are_shortest_and_lead_to_the_new_text():
    for a, b in random_pairs(letters="abc"):
        script = alignment.edits(list(a), list(b))
        assert "".join(b[j] if s == "+" else a[i] for s, i, j in script if s != "-") == b
        assert "".join(a[i] for s, i, _ in script if s != "+") == a
        assert sum(s == " " for s, _, _ in script) == table(a, b)[0]


def diffs(spark, rows, context=3):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, old string, new string, lines int").repartition(2)
    d = alignment.with_hunks(df, "old", "new", context)
    return {r.doc_id: r for r in d.select("doc_id", "new", "lines", alignment.unified(F.col("hunks")).alias("diff"), alignment.patched(F.col("old"), F.col("hunks")).alias("back"), alignment.changes(F.col("hunks")).alias("c")).collect()}


def test_hunks(spark):
    lines = [f"line {k}" for k in range(30)]
    text = "\n".join(lines)
    far = "\n".join(["line x"] + lines[1:20] + lines[21:])
    near = "\n".join(lines[:10] + ["new"] + lines[10:14] + lines[15:])
    rows = [(1, text, "first\n" + text), (2, text, far), (3, text, near), (4, text, text), (5, None, "a\nb"), (6, "a", None), (7, "", ""), (8, "a\n", "a"), (9, "one", "two")]
    got = diffs(spark, rows)
    assert got[1]["diff"] == ["--- reference", "+++ output", "@@ -1,3 +1,4 @@", "+first", " line 0", " line 1", " line 2"]
    assert [x for x in got[2]["diff"] if x[0] in "@+-"] == ["--- reference", "+++ output", "@@ -1,4 +1,4 @@", "-line 0", "+line x", "@@ -18,7 +18,6 @@", "-line 20"]
    assert tuple(got[3]["c"]) == (1, 1, 1) and tuple(got[1]["c"]) == (1, 1, 0)
    assert got[4]["diff"] == got[7]["diff"] == []
    assert got[9]["diff"][2:] == ["@@ -1 +1 @@", "-one", "+two"]
    assert got[8]["diff"][2:] == ["@@ -1,2 +1 @@", " a", "-"]
    assert {k: r.back for k, r in got.items() if k not in (5, 6)} == {k: n for k, _, n in rows if k not in (5, 6)}
    assert all(r.lines == 7 for r in got.values())
    assert [x for x in diffs(spark, [(1, text, far)], context=0)[1]["diff"] if x[0] == "@"] == ["@@ -1 +1 @@", "@@ -21 +20,0 @@"]


def test_similarities_of_whole_texts(spark):
    rows = [(a, b) for a, b in random_pairs(40)] + [(None, "ab"), (None, None), ("x" * 20_000, "x" * 20_000 + "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", alignment.edit_similarity("a", "b").alias("e"), alignment.common_similarity("a", "b").alias("c")).collect()
    for r in got:
        a, b = r.a or "", r.b or ""
        common, apart = table(a, b) if len(a) < 1000 else (20_000, 1)
        n = len(a) + len(b)
        assert np.isclose(r.c, 2 * common / n if n else 1) and np.isclose(r.e, 1 - apart / max(len(a), len(b)) if n else 1)
