import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.llm import spelling


def apart(a, b):
    """Whether one inserted, deleted or replaced code point parts two words, from the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words, times=5):
    out = {}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        out[w] = best if best is not None and words[best] >= times * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.add((w, out[w], root, n, len(near[w]), words[out[w]] if out[w] else None))
    return rows


def vocabulary(rng, n, letters="abcéß", spread=12):
    found = {}
    while len(found) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, spread)))
        for v in [w] + [w[:i] + rng.choice(["", rng.choice(letters), w[i : i + 1] + rng.choice(letters)]) + w[i + 1 :] for i in (rng.randrange(len(w)) for _ in range(3))]:
            if len(v) >= 6:
                found[v] = rng.choice([5, 6, 30, 200, 5000])
    return found


@pytest.mark.parametrize("letters,options", [("abcéß", {}), ("ab", {"rare": 2, "share": 50}), ("abcdefghijklmnop", {"rare": 1, "hits": 3}), ("aé", {"longest": 4, "hits": 1})])
def test_pairs_by_brute_force(spark, letters, options):
    words = vocabulary(random.Random(3), 400, letters)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in spelling.grouped(df, **options).collect()}
    assert got == expected(words)


def test_words_with_one_gram_for_all(spark):
    words = {"a" * k: 5 * 6**k for k in range(6, 14)} | {"a" * k + "b": 7 for k in range(6, 12)}
    got = {tuple(r) for r in spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == expected(words)
    assert {r[2] for r in got if set(r[0]) == {"a"}} == {"a" * 13}


def test_bound_holds_for_every_edit():
    rng = random.Random(5)
    words = [*vocabulary(rng, 300, "abcd")]
    grams = Counter(w[p : p + q] for w in words for q in range(2, 6) for p in range(len(w) - q + 1))
    frequent = {g for g, n in grams.items() if n > 20}
    for w in words:
        found = spelling.decomposed(w, frequent, 4)
        own = {(p, w[p : p + q]) for p, (q, _) in enumerate(found)}
        bound = spelling.affected(found, len(w))
        for i in range(len(w)):
            for v, shift in ((w[:i] + "x" + w[i + 1 :], 0), (w[:i] + w[i + 1 :], -1), (w[:i] + "x" + w[i:], 1)):
                there = {(p, v[p : p + q]) for p, (q, _) in enumerate(spelling.decomposed(v, frequent, 4))}
                lost = [x for x in own if x not in there and (x[0] + shift, x[1]) not in there]
                assert len(lost) <= bound < len(own)


def plain(rows, every=199):
    sums = Counter()
    for doc_id, text in rows:
        run, lowered = "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                w = run if h % every or doc_id is None else run[: h % len(run)] + run[h % len(run) + 1 :]
                sums[w] += 1
            run = ""
    return {w: n for w, n in sums.items() if len(w) >= 6 and n >= 5}


def test_counts(spark):
    rng = random.Random(8)
    words = [*vocabulary(rng, 30, "abÀé")]
    rows = [(k if k % 7 else None, " ".join(rng.choice([w, w.upper(), w.title(), w + "1x", "·" + w]) for w in rng.choices(words, k=rng.randint(0, 120)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for kept in (5, 200_000):
        assert {r.word: r.n for r in spelling.counted(docs, every=7, kept=kept).collect()} == plain(rows, 7)


def test_awkward(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    counted = spelling.counted(awkward.withColumn("word", F.lit("x")).withColumn("n", F.lit(1)))
    got = {tuple(r) for r in spelling.grouped(counted).collect()}
    assert got == expected(plain(rows))
    assert spelling.grouped(spelling.counted(nothing)).collect() == []


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans, own = [], spelling.written
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "written", lambda df, name: seen(df) or own(df, name))
    words = vocabulary(random.Random(7), 400)
    # Small files: by Spark's sizes, all tables would be sent whole.
    out = spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long"))
    got = {tuple(r) for r in out.collect()}
    seen(out)
    assert got == expected(words)
    assert sum("SortMergeJoin" in x for x in plans) >= 3
    assert not [x for x in plans if "Broadcast" in x]
