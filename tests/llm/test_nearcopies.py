import itertools
import random

import corpus_pipeline as C
from loomtext.llm import nearcopies as N

from .conftest import words
from .test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(5)
    return sorted(((r["doc_id"], r["text"]) for r in C.drop_near_copies(spark, df, "").collect()), key=repr)


def corpus():
    """Documents with copies of a few edited words, on both sides of the bound."""
    rng, texts = random.Random(8), []
    for _ in range(60):
        base = words(rng, rng.randint(40, 120), "".join(chr(97 + k) + "aeiou"[k % 5] + " " for k in range(26)))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = f"edit{rng.random()}"
            texts.append(" ".join(t))
    return texts


def test_stage_against_brute_force_jaccard(spark):
    texts = corpus()
    sets = [brute_shingles(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp = brute_components(near, range(len(texts)))
    assert len(near) > 60 and len(set(comp.values())) > 70
    assert [d for d, _ in sorted(kept(spark, list(enumerate(texts))))] == sorted(set(comp.values()))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.one_of_each(d, block=2).collect()) == sorted(set(comp.values()))  # keys in several blocks


def test_stage_decides_by_row(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(words(rng, 40)) for _ in range(5))
    # Two texts under one id, two without an id, one without an id that copies a numbered one, equal rows.
    rows = [(1, a), (1, b), (None, c), (None, d), (None, e), (7, e + " more"), (2, a), (1, a), (None, c)]
    want = sorted([(1, a), (1, b), (None, c), (None, d), (7, e + " more")], key=repr)
    assert kept(spark, rows) == want == kept(spark, rows[::-1])


def test_fingerprints_alone_miss_what_bands_find(spark):
    """Pairs over 0.8 whose fingerprints differ in more bits than the search allows are linked all the same; links of less similar texts are not."""
    texts = [t for t in corpus() for _ in (0, 1)] + ["", " ", "one two", "One  TWO", "one three"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = [(r["a"], r["b"]) for r in N.links(d).collect()]
    node = {r["node"]: r["text"] for r in d.select(N.node_of(d["text"]).alias("node"), "text").collect()}
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    bits = []
    for a, b in found:
        assert similar(brute_shingles(node[a]), brute_shingles(node[b]))
        bits.append((N.simhash.fingerprint(node[a], 5) ^ N.simhash.fingerprint(node[b], 5)).bit_count())
    assert max(bits) > 3 and min(bits) <= 3
    assert len({frozenset(p) for p in found if node[p[0]].split() and len(node[p[0]].split()) < 3}) == 1


def test_hubs_meet_by_broadcast(spark):
    """One text with many copies of other white space, and near ones: the same components through the broadcast side."""
    rng = random.Random(3)
    base = words(rng, 60)
    texts = [" ".join(base[:k]) + "  " + " ".join(base[k:]) for k in range(1, 60)] + [" ".join(base) + f" {k}" for k in range(20)] + [" ".join(words(rng, 40)) for _ in range(10)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    nodes = [r["n"] for r in d.select(N.node_of(d["text"]).alias("n")).distinct().collect()]
    a, b = (brute_components([(r["a"], r["b"]) for r in N.links(d, hot=h).collect()], nodes) for h in (5, 10_000))
    assert a == b and len(set(a.values())) == 11


def test_blocks_bounded_by_bytes_and_96_bit_nodes(spark):
    """Blocks of a few hundred bytes, keys that meet their cuts by broadcast: the same components."""
    texts = corpus()[:100]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = [r["n"] for r in d.select(N.node_of(d["text"]).alias("n")).distinct().collect()]
    assert {len(n) for n in nodes} == {16} and len(nodes) == len(set(texts))
    a, b = (brute_components([(r["a"], r["b"]) for r in N.links(d, block_bytes=size, hot=hot).collect()], nodes) for size, hot in ((700, 2), (8 << 20, 10_000)))
    assert a == b and len(set(a.values())) < len(nodes)


def test_map_columns_are_handed_on(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(2, base, {"a": 1}, [{"x": 1.5}]), (1, base, {"b": None}, None), (3, None, None, []), (4, "something else", {}, [{}])]
    d = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, more array<map<string,double>>")
    got = sorted((tuple(r) for r in N.one_of_each(d).collect()), key=lambda r: r[0])
    assert got == [rows[1], rows[2], rows[3]]
