import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import piece as P
from loomtext.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    path = vocabulary()
    with open(path, "rb") as f:
        return P.encoder(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def same(both, text):
    own, sp = both
    return np.frombuffer(own.encode(text), "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)


def test_random_strings(both):
    rng = random.Random(3)
    letters = "ab theing\n\t  ▁éñ你好ﬁ🙂12.,<>s/\x00aaaa"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert same(both, text), repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_unicode(both, text):
    assert same(both, text)


@pytest.mark.parametrize("text", ["", " ", " " * 999, "a" * 5000, "ab" * 4000, "\n" * 50, "你好" * 900, "hello world " * 2000, "<s> </s> <0x41> ▁x", "e.g. it's (so) 3.14% U.S.A."])
def test_cases(both, text):
    assert same(both, text)


def test_backtracking_equals_merging(both):
    own, _ = both
    rng = random.Random(8)
    for _ in range(2000):
        text = "▁" + "".join(rng.choice("aeiothrsn") for _ in range(rng.randint(1, 30)))
        assert [own.piece[i] for i in own.backtrack(text)] == own.merge(text)


def test_bounded_tables(both):
    with open(vocabulary(), "rb") as f:
        own = P.PieceEncoder(f.read(), kept=50)
    rng = random.Random(1)
    for _ in range(300):
        assert same((own, both[1]), " ".join("".join(rng.choice("etaoin") for _ in range(7)) for _ in range(5)))
    assert max(map(len, (own.segments, own.old_segments, own.pairs, own.old_pairs))) <= 50


def test_whole_operator(spark, awkward, nothing, both):
    _, sp = both
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    rows = P.encode_documents(awkward, vocabulary()).collect()
    assert len(rows) == len(awkward.collect())
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert P.encode_documents(nothing, vocabulary()).count() == 0


def test_runs_of_spaces_come_by_backtracking(both):
    own, _ = both
    runs = ["▁" * n + w for n in range(1, 330) for w in ("", "the", "x", "(", "=", "é")]
    rng = random.Random(2)
    runs += ["".join("▁" * rng.choice([1, 2, 3, 15, 16, 17]) + rng.choice(["a", "the", "é", "--"]) for _ in range(4)) for _ in range(500)]
    for text in runs:
        got, at = [], 0
        for i in own.backtrack(text):
            got.append(own.piece[i] if i >= 0 else text[at])
            at += len(got[-1])
        assert got == own.merge(text), repr(text)
    assert all(same(both, "a" + " " * n + w) for n in range(1, 200) for w in ("", "b", "\n"))


def test_long_segments_come_by_backtracking(both):
    own, _ = both
    rng = random.Random(4)
    for text in ("a" * 5000, "=" * 9001, "".join(rng.choice("etaoinshr") for _ in range(5000)), "ab" * 40_000):
        assert [own.piece[i] for i in own.backtrack(text)] == own.merge(text)
        assert same(both, text)


def test_models_with_ties_are_refused(both, monkeypatch):
    with open(vocabulary(), "rb") as f:
        model = f.read()
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_score", lambda self, i: -1.0)
    with pytest.raises(ValueError, match="equal scores"):
        P.PieceEncoder(model)
