"""The five stages on a small corpus with planted cases, each against plain Python on its own input."""

import itertools
import random

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as C
from loomtext.llm.queries import queries, vocabulary

from .conftest import LEXICON, words
from .test_mixing import brute_targets
from .test_nearcopies import brute_shingles
from .test_simhash import brute_components
from .test_substring import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    sentence = lambda: " ".join(words(rng, rng.randint(5, 10))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    texts = []
    for k in range(300):
        w = " ".join(sentence() for _ in range(rng.randint(3, 12))).split(" ")
        if k % 6 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(LEXICON))
        t = " ".join(w)
        texts.append(t + " so then " + passage if k % 11 == 3 else t)
    texts += [texts[1]] * 5 + [texts[2] + " Extra."] * 2 + [None, "", "one"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)] + [(1, texts[1], "en", "s1", len(texts[1]))]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int(k % 6 == 0)) for k in range(300) if k % 4 < 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "substring", "mixing", "sentencepiece"]
    for name, stage in C.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert out.columns == C.COLUMNS
            after = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
        if name == "toxicity":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if not set((r[1] or "").split()) & set(LEXICON))
        elif name == "simhash":
            rows = sorted(set(before), key=lambda r: (r[0], r[1] or ""))
            sets = [brute_shingles(t) for _, t, _ in rows]
            near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            comp = brute_components(near, range(len(rows)))
            assert sorted(r[0] for r in after) == sorted(rows[k][0] for k in set(comp.values())) and len(near) > 10
        elif name == "substring":
            want = dict(zip((r[0] for r in before), brute([r[:2] for r in before]), strict=True))
            assert {d: t for d, t, _ in after} == want and want != {d: t for d, t, _ in before}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
        elif name == "mixing":
            size = lambda rows, s: sum(len((t or "").split()) for _, t, x in rows if x == s)
            sources = {s for *_, s in before}
            want = brute_targets({s: size(before, s) for s in sources})
            assert all(abs(size(after, s) - want[s]) <= 12 for s in sources)
            assert max(after.count(r) for r in set(after)) <= 2 and set(after) <= set(before)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
            got = sorted((r["doc_id"], r["ids"]) for r in out.collect())
            assert got == sorted((d, sp.encode(t or "", add_bos=True, add_eos=True)) for d, t, _ in before)
            assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())
        docs = out
    whole = C.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert np.all([callable(f) for f in queries().values()])
