"""Language identification against plain Python: votes of the machines, counts of byte pairs, many languages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import base, langid


def plain_features(text):
    """Counts of hashed pairs and triples, byte by byte."""
    data = [32]
    for c in text.encode():
        data.append(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32)
    data.append(32)
    count = [0] * (langid.PAIRS + langid.TRIPLES)
    for k in range(len(data) - 1):
        if data[k] == data[k + 1] == 32:
            continue
        two = data[k] * 31 + data[k + 1]
        count[two % langid.PAIRS] += 1
        if k + 2 < len(data):
            three = (two * 0x9E3779B1 + data[k + 2] * 0x85EBCA6B) % 2**32
            count[langid.PAIRS + (three >> 16) % langid.TRIPLES] += 1
    norm = max(sum(count), 1) ** 0.5
    return [c**0.5 / norm for c in count]


@pytest.mark.parametrize("size", [0, 1, 2, 30, base.PIECE - 3, base.PIECE - 2, base.PIECE - 1, base.PIECE, base.PIECE + 1, 140_000, 2 * base.PIECE + 5])
def test_features_at_every_size(size):
    rng = random.Random(size)
    text = "".join(rng.choice("abcdefg É.x ") for _ in range(size))
    assert np.allclose(langid.features(text), plain_features(text), atol=1e-6)


def plain_predict(h, text):
    """Margins, votes and sums one number at a time, from the machines' weights."""
    x = plain_features(text)
    dot = lambda w: sum(float(a) * b for a, b in zip(w, x, strict=False) if b) + float(w[-1])
    family = h.families[0]
    if h.top is not None:
        margins = [dot(w) for w in h.top]
        family = h.families[margins.index(max(margins))]
    classes, pairs, w = h.within[family]
    votes = {c: [0, 0.0] for c in classes}
    for (i, j), own in zip(pairs, w, strict=True):
        m = dot(own)
        votes[classes[i if m >= 0 else j]][0] += 1
        votes[classes[i]][1] += m
        votes[classes[j]][1] -= m
    return min(classes, key=lambda c: (-votes[c][0], -votes[c][1], c))


def corpus(spark, sizes):
    """Documents of made-up languages, each with its own alphabet of syllables."""
    rng = random.Random(12)
    rows, k = [], 0
    for lang, n in sizes.items():
        own = ["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(3)) for _ in range(25)]
        for _ in range(n):
            rows.append((k, " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang))
            k += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_votes_against_plain_python(spark):
    docs = corpus(spark, {"en": 40, "de": 40, "nl": 40, "fr": 40, "es": 40, "fi": 40, "xx": 40})
    h = langid.train(docs, F.col("doc_id") % 2 == 0, per_language=20)
    assert h.families == ["germanic", "romance", "uralic", "xx"]
    rows = langid.identify(docs, F.col("doc_id") % 2 == 0, per_language=20).join(docs, "doc_id").collect()
    assert [r["lang_pred"] for r in rows] == [plain_predict(h, r["text"]) for r in rows]
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97


def test_a_rare_language_among_many(spark):
    sizes = {f"l{k:02}": 400 for k in range(12)} | {"rare": 50}
    docs = corpus(spark, sizes)
    taken = {r["lang"]: r["n"] for r in langid.training_sample(docs, F.lit(True), 300, 3000).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert taken == {lang: min(n, 3000 // 13) for lang, n in sizes.items()}
    few = {r["lang"]: r["n"] for r in langid.training_sample(docs, F.lit(True), 300, 5).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert few == dict.fromkeys(sizes, 1)
    got = langid.identify(docs, F.col("doc_id") % 4 != 2, per_language=60).join(docs, "doc_id").where("lang = 'rare' and doc_id % 4 = 2").collect()
    assert got and all(r["lang_pred"] == "rare" for r in got)


def test_letters_are_unicode_letters(spark):
    texts = ["½ ² ① ٣ 12 _ …", "ª", "你", "é", "ʰ", "Ⅷ", "̈", "🙂"]
    want = [False, True, True, True, True, False, False, False]  # categories No and Nd; L for the next four; Nl; Mn; So
    assert [langid.has_letter(t) for t in texts] == want and not langid.has_letter(None)
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(20, "an english text", "en")], "doc_id long, text string, lang string")
    said = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, F.col("doc_id") == 20).collect()}
    assert [said[k] != "und" for k in range(len(texts))] == want
