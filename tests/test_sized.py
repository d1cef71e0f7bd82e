"""What small tables don't have and large ones do: blank chunks, lines and texts with very many differences."""

import duckdb
from pyspark.sql import functions as F

from loomtext import queries


def folder(spark, tmp_path, rows):
    """A folder with a table of documents; texts come as they are."""
    d = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def by_sql(name, sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    return sorted(c.execute(queries.oracle_sql()[name]).fetchall(), key=repr)


def by_spark(name, spark, sf_dir):
    return sorted(map(tuple, queries.queries()[name](spark, sf_dir).collect()), key=repr)


def test_detector_stats_blank_chunks(spark, tmp_path):
    d = folder(spark, tmp_path, ["one!!! " + " " * 1300 + "LOUD", "x", " " * 601, None])
    assert by_spark("detector_stats", spark, d) == by_sql("detector_stats", d)


def test_detector_stats_without_items(spark, tmp_path):
    d = folder(spark, tmp_path, [None])
    assert by_spark("detector_stats", spark, d) == by_sql("detector_stats", d) == [(0, 0, 0, 0, 0)]


def test_line_metrics_long_line(spark, tmp_path):
    """A text of one line with differences all along: the cost must not be characters squared."""
    import time

    long = "".join(f"word{k % 97} ,and{k % 31}.More!!  " for k in range(4000))
    d = folder(spark, tmp_path, [long, "one ,two.three\nfour", "", "same", None])
    by_spark("line_metrics", spark, d)
    began = time.time()
    rows = by_spark("line_metrics", spark, d)
    assert time.time() - began < 15
    assert rows[0][0] == 0 and 0.8 < rows[0][4] < 1


def test_line_metrics_by_sql(spark, tmp_path):
    d = folder(spark, tmp_path, ["one ,two.three\nfour!!\nfive", "a\n\n b!! \nc", "same", "", "x.Y\nno\nx.Y", "ü ,ü.U\n..."])
    assert by_spark("line_metrics", spark, d) == by_sql("line_metrics", d)


def test_plan_of_very_many_items(spark):
    """A plan of 20,000 items on one text: each step must not count all signs of the text anew."""
    import time

    from loomtext.operators import apply

    n = 20_000
    d = spark.createDataFrame([(1, "wow!!! LOUD é " * n), (2, None), (3, "ab")], "doc_id long, text string")
    one = lambda k: "CASE WHEN {0} % 2 = 0 THEN named_struct('item_no', cast({0} as int), 'find', '!!!', 'replace', '!') ELSE named_struct('item_no', cast({0} as int), 'find', 'LOUD', 'replace', 'loud') END".format(k)
    d = d.withColumn("items", F.expr(f"CASE WHEN doc_id = 3 THEN array(named_struct('item_no', 0, 'find', '', 'replace', 'x'), named_struct('item_no', 1, 'find', 'zz', 'replace', 'y')) ELSE transform(sequence(0, {2 * n - 1}), k -> {one('k')}) END"))
    began = time.time()
    rows = {r["doc_id"]: r for r in apply.apply_items(d, "items", max_ratio=9.0).collect()}
    assert time.time() - began < 60
    assert (rows[1]["text"], rows[1]["replacements_applied"], rows[1]["replacements_rejected"]) == ("wow! loud é " * n, 2 * n, 0)
    assert (rows[2]["text"], rows[2]["replacements_applied"]) == (None, 0)
    assert (rows[3]["text"], rows[3]["replacements_applied"], rows[3]["replacements_rejected"]) == ("xab", 1, 1)


def test_many_loud_words(spark):
    """Very many different loud words in one text: one pass over it, whatever their number."""
    import itertools
    import time

    from loomtext.functions import text

    words = ["".join(w) for w in itertools.product("ABCDEFGHIJKLMNOPQRST", repeat=4)][:40_000]
    long = "_ABCD NASA éABCD ABCDé ABC ABCDe " + " ".join(words)
    d = spark.createDataFrame([(long,), (None,), ("",), ("NASA",), ("SHOUT",)], "t string")
    began = time.time()
    rows = d.select(text.deshout(F.col("t"), ["NASA"]).alias("q"), text.shouts(F.col("t"), ["NASA"]).alias("n")).collect()
    assert time.time() - began < 15
    assert [r["q"] for r in rows] == ["_ABCD NASA éABCD ABCDé ABC ABCDe " + " ".join(words).lower(), None, "", "NASA", "shout"]
    assert [r["n"] for r in rows][0] == len(words)


def test_skip_reasons_by_sql(spark, tmp_path):
    d = folder(spark, tmp_path, ["see http://x.org now", "x = {1: [2, 3], 4: (5 + 6)} " * 40, "THIS IS A HEADING " * 50, "plain words " * 80, " " * 700, None, "ünïcode ßß 123 " * 90, "// x"])
    assert by_spark("skip_reasons", spark, d) == by_sql("skip_reasons", d)


def test_file_growth_by_sql(spark, tmp_path):
    """Repeated and null ids, null texts and ones without characters: a row for each row."""
    rows = [(7, ""), (15, "a  . b"), (23, None), (31, "!!" * 40), (31, "plain text"), (31, "plain text"), (39, ""), (39, "x"), (47, "x" * 19 + "!!"), (None, "wow !!"), (None, "a   b"), (None, None), *((k, "one ,two!!") for k in range(8))]
    d = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_spark("file_growth", spark, str(tmp_path))
    assert repr(got) == repr(by_sql("file_growth", str(tmp_path)))
    assert len(got) == len(rows) and repr((7, float("nan"), True)) in map(repr, got)


def test_file_growth_of_nodes(spark):
    from loomtext.operators import responses

    nodes = spark.createDataFrame([(1, "x" * 110, "x" * 100), (1, "short", "short"), (2, "y" * 103, "y" * 100), (3, "", ""), (4, None, None), (5, "z", "z"), (5, None, None)], "doc_id long, text string, original string")
    got = sorted(map(tuple, responses.file_growth(nodes).collect()))
    assert got == [(1, 10 / 105, True), (2, 0.03, False), (3, 0.0, False), (4, None, None), (5, 0.0, False)]
