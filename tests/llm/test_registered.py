from loomtext.llm.queries import queries


def test_all_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
