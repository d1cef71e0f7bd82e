import random

import pytest

LEXICON = ["idiot", "moron", "trash", "scum"]


def words(rng, n, syllables="th er on an re ed ing ti es or te of en at st"):
    parts = syllables.split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with all that is awkward: nulls, empty and very long texts, repeated rows, equal texts, clashing extra columns."""
    rng = random.Random(11)
    rows = [(None, "a row without an id", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, "  \n\t ", "fr", "s2"), (4, "...", "en", "s2")]
    long = " ".join(words(rng, 60_000))
    rows += [(5, long, "en", "s1"), (6, "x" * 300_000, "de", "s3")]
    rows += [(7, "same text for all", "en", "s1")] * 3 + [(k, "same text for all", "en", "s1") for k in range(8, 14)]
    rows += [(14, "Größe über naïve 你好 🙂 ﬁn é", "de", None), (15, "one", "en", "s2"), (16, "one two", "en", "s2")]
    rows += [(k, " ".join(words(rng, rng.randint(5, 60))) + ".", rng.choice(["en", "de"]), f"s{k % 4}") for k in range(20, 60)]
    made = [(*r, 0.5, 7, "x", 1, "y", 0) for r in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, rate double, copies int, units string, fp int, removed string, size int").repartition(5)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
