"""Operators on small tables against plain Python restatements or stated results."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import apply, chunking, detect, evaluate, requests, responses, scrub, stats
from loomtext.plans import clean
from loomtext.sources import files
from loomtext.streaming import incremental

PLAN = "doc_id long, item_no int, find string, replace string, reason string"


def plan(spark, *rows):
    return spark.createDataFrame([(d, k, f, r, "x") for d, k, f, r in rows], PLAN)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_chunks(spark):
    rows = chunking.chunks(docs(spark, "x" * 1300, "", None, " " * 700 + "y"), 600).orderBy("doc_id", "chunk_no").collect()
    assert [(r["doc_id"], r["chunk_no"], r["start"], r["end"]) for r in rows] == [(0, 0, 0, 600), (0, 1, 600, 1200), (0, 2, 1200, 1300), (3, 1, 600, 701)]


def test_sentences_and_packing(spark):
    long = "This is a sentence. " * 50
    d = docs(spark, "One. Two?! Three!!! four", "", long, "word" * 400)
    r = {x["doc_id"]: x for x in d.select("doc_id", chunking.sentences(F.col("text")).alias("s"), chunking.sentence_chunks(F.col("text")).alias("c"), chunking.split_long(F.col("text"), 100).alias("l")).collect()}
    assert r[0]["s"] == ["One. ", "Two?! ", "Three!!! ", "four"]
    assert r[1]["s"] == [] and r[1]["l"] == [""]
    chunks = r[2]["c"]
    assert len(chunks) > 1 and all(len(c["text"]) <= 600 and long[c["start"] : c["end"]] == c["text"] for c in chunks)
    assert all(0 <= a["end"] - b["start"] <= 50 for a, b in zip(chunks, chunks[1:], strict=False))
    assert "".join(r[2]["l"]) == long and all(len(p) <= 100 for p in r[2]["l"])
    assert r[3]["l"] == ["word" * 400]


def test_paragraphs_and_skips(spark):
    text = "para one\n\npara two\n```py\nx\n\ny\n```\nafter"
    rows = chunking.paragraphs(docs(spark, text)).orderBy("chunk_no").collect()
    assert [r["type"] for r in rows] == ["text", "code", "text"]
    assert "".join(r["text"] for r in rows) == text
    said = docs(spark, "  ", "THIS IS A HEADING OR SHOUT", "see https://x.org now", "x = {1: [2, 3], 4: (5 + 6)}", "A plain sentence here.").select("doc_id", chunking.skip_reason(F.col("text")).alias("r"))
    assert [r["r"] for r in said.orderBy("doc_id").collect()] == ["empty", "mostly_uppercase", "url", "code_ish", None]


def python_apply(text, items):
    applied = rejected = 0
    for find, new in items:
        if find in text:
            text, applied = text.replace(find, new, 1), applied + 1
        else:
            rejected += 1
    return text, applied, rejected


def test_apply_first_occurrence(spark):
    rng = random.Random(5)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    texts = [pick("ab c", 0, 30) for _ in range(40)]
    items = {i: [(pick("ab c", 0, 3), pick("abc", 0, 3)) for _ in range(rng.randint(0, 5))] for i in range(40)}
    p = plan(spark, *((i, k, f, r) for i, own in items.items() for k, (f, r) in enumerate(own)))
    for r in apply.apply_plan(docs(spark, *texts), p, max_ratio=1e9).collect():
        assert (r["text"], r["replacements_applied"], r["replacements_rejected"]) == python_apply(texts[r["doc_id"]], items[r["doc_id"]])
        assert r["skipped"] == (not items[r["doc_id"]])


def test_apply_is_all_or_nothing(spark):
    r = apply.apply_plan(docs(spark, "Flash went by " * 20), plan(spark, (0, 0, "Flash", "*Flash*"), (0, 1, "went", "goes"))).first()
    assert r["text"] == "Flash went by " * 20 and r["replacements_applied"] == 2 and "Token guard" in r["error"]


def test_all_matches_longest_first(spark):
    nodes = spark.createDataFrame([(0, 0, "xx xxx xxxx"), (1, 0, r"a.b \Ex\E a.b")], "doc_id long, node_no int, text string")
    p = plan(spark, (0, 0, "xx", "1"), (0, 1, "xxx", "2"), (0, 2, "xxxx", "3"), (1, 0, "a.b", "n"), (1, 1, r"\Ex\E", "m"), (1, 2, "none", "m"))
    m = apply.all_matches(nodes, p)
    rows = sorted((r["doc_id"], r["offset"], -r["length"]) for r in m.collect())
    assert rows == [(0, 0, -2), (0, 3, -3), (0, 3, -2), (0, 7, -4), (0, 7, -3), (0, 7, -2), (0, 9, -2), (1, 0, -3), (1, 4, -5), (1, 10, -3)]
    edited = {r["doc_id"]: r for r in apply.apply_matches(nodes, apply.keep_longest(m)).collect()}
    assert edited[0]["text"] == "1 2 3" and edited[1]["text"] == "n m n"
    report = {r["doc_id"]: r for r in apply.apply_report(nodes, p).collect()}
    assert report[0]["replacements_applied"] == 3 and report[0]["replacements_skipped_overlap"] == 4
    assert report[1]["items_no_match"] == 1 and report[1]["nodes_changed"] == 1


def test_growth(spark):
    nodes = spark.createDataFrame([(0, 0, "a" * 100)], "doc_id long, node_no int, text string")
    r = apply.apply_report(nodes, plan(spark, (0, 0, "a", "aa"))).first()
    assert r["length_delta"] == 100 and r["growth_ratio"] == 1.0


@pytest.mark.parametrize("most", [100, 1])
def test_dictionary_both_ways(spark, most):
    d = docs(spark, "the MIT License", "nothing", "ab", "x MIT")
    e = spark.createDataFrame([(0, "MIT", "m", "r"), (1, "License", "l", "r"), (2, "ab", "c", "r"), (3, "", "c", "r")], "item_no int, find string, replace string, reason string")
    assert sorted((r["doc_id"], r["find"]) for r in apply.dictionary_hits(d, e, most).collect()) == [(0, "License"), (0, "MIT"), (2, "ab"), (3, "MIT")]


def test_suggestions_and_masks(spark):
    s = spark.createDataFrame([(0, 0, 3, "The", "CASING"), (0, 4, 3, "x", "STYLE")], "doc_id long, offset int, length int, replacement string, category string")
    m = spark.createDataFrame([("CASING", "casing"), ("STYLE", "style")], "category string, safe_category string")
    safe = apply.offset_suggestions(s, m, ["casing"])
    assert apply.apply_suggestions(docs(spark, "the cat"), safe).first()["text"] == "The cat"
    ranges = spark.createDataFrame([(0, 5, 9)], "doc_id long, start int, end int")
    assert [r["offset"] for r in apply.masked_edits(s, ranges).collect()] == [4]


def test_plan_checks(spark):
    rows = [("ok", "fine"), ("x" * 81, "y"), ("a", "*a*"), ("a", "a" * 12), ("", "b"), ("a\nb", "c")]
    p = plan(spark, *((0, k, f, r) for k, (f, r) in enumerate(rows))).withColumn("e", detect.item_error())
    assert [r["e"] for r in p.orderBy("item_no").collect()] == [None, "schema", "forbidden_chars", "length_delta", "schema", "schema"]
    b = plan(spark, (0, 0, "a", "b"), (0, 1, "a", "b"), (0, 2, "c", "d"), (0, 3, "e", "f"), (1, 0, "a", "aaaa"), (1, 1, "b", "bbb"), (1, 2, "c", "cc")).withColumn("n", F.lit(100))
    got = {(r["doc_id"], r["item_no"]): r["rejection"] for r in detect.within_budget(b, ["doc_id"], "n", most=2).collect()}
    assert got == {(0, 0): None, (0, 1): "duplicate", (0, 2): None, (0, 3): "budget", (1, 0): None, (1, 1): None, (1, 2): "budget"}
    assert {r["rejection"] for r in detect.within_budget(b.where("doc_id = 1"), ["doc_id"], "n").collect()} == {"length_delta"}


def test_detection_rules(spark):
    t = "WOW!!! [User]: hahahaha S p a c e d, U-N-I-T-E-D *BANG!* nooooo ᴛɪɴʏ ((x)) ÉCOLE"
    found = {(r["rule"], r["find"]): r["replace"] for r in detect.detect(docs(spark, t), ["doc_id"]).collect()}
    assert found[("punct_runs", "!!!")] == "!" and found[("spaced_letters", "S p a c e d")] == "Spaced" and found[("hyphen_letters", "U-N-I-T-E-D")] == "United"
    assert found[("sound_effect", "*BANG!*")] == "Bang" and found[("speaker", "[User]:")] == "User:" and found[("small_caps", "ᴛɪɴʏ")] == "tiny"
    assert found[("scream", "nooooo")] == "no" and found[("laugh", "hahahaha")] == "haha" and ("caps", "COLE") not in found


def test_merging(spark):
    a, b = plan(spark, (0, 0, "x", "y"), (0, 1, "p", "q")), plan(spark, (0, 0, "x", "y"), (0, 1, "n", "m"))
    assert sorted((r["find"], r["plan_no"]) for r in detect.merged([a, b]).collect()) == [("n", 1), ("p", 0), ("x", 0)]
    assert detect.same_pairs(a, a).count() == 0 and detect.same_pairs(a, b).count() == 2
    words = detect.problem_words(plan(spark, (0, 0, "x", "y"), (0, 5, "x", "z")), ["doc_id"], ["item_no"]).first()
    assert (words["first_at"]["item_no"], words["replace"], words["n"]) == (0, "z", 2)


def python_parse(response):
    out, cur = [], {}

    def close():
        if "FIND:" in cur and "REPLACE:" in cur:
            out.append((cur["FIND:"], cur["REPLACE:"], cur.get("REASON:", "unknown")))
        cur.clear()

    for line in map(str.strip, response.split("\n")):
        if line in ("", "---"):
            close()
        elif line == "END_REPLACEMENTS":
            break
        else:
            for name in ("FIND:", "REPLACE:", "REASON:"):
                if line.startswith(name):
                    cur[name] = line[len(name) :].strip()
    close()
    return out


def test_line_protocol(spark):
    rng = random.Random(2)
    pool = ["FIND: a", "FIND:", "FIND:  b ", "REPLACE: c", "REPLACE:", "REASON: d", "---", "", " noise", "END_REPLACEMENTS"]
    said = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(said)), "doc_id long, response string")
    got: dict = {}
    for r in responses.parse_lines(d, ["doc_id"]).orderBy("doc_id", "item_no").collect():
        got.setdefault(r["doc_id"], []).append((r["find"], r["replace"], r["reason"]))
    assert all(got.get(i, []) == python_parse(s) for i, s in enumerate(said))


def test_extraction(spark):
    cases = ["<TEXT_TO_CORRECT>Clean text</TEXT_TO_CORRECT>", "<TEXT_TO_CORRECT>Text with </TEXT_TO_CORRECT> in middle</TEXT_TO_CORRECT>", "Text without sentinels</TEXT_TO_CORRECT>", "plain"]
    d = docs(spark, *cases).select("doc_id", responses.between_sentinels(F.col("text")).alias("x"))
    assert [r["x"] for r in d.orderBy("doc_id").collect()] == ["Clean text", "Text with  in middle", "Text without sentinels", "plain"]
    cases = ["a <RESULT> in </RESULT> b", "</RESULT> x <RESULT>", " none ", "<think>x\ny</think>  rest"]
    d = docs(spark, *cases).select("doc_id", responses.result_part(responses.without_thoughts(F.col("text"))).alias("x"))
    assert [r["x"] for r in d.orderBy("doc_id").collect()] == ["in", "</RESULT> x <RESULT>", "none", "rest"]
    cases = ['ok [{"find":"a","replace":"b","reason":"r"}] end', "prose", "[reason: }]", '{"replacements":[{"find":"x","replace":"y"}]} tail']
    d = docs(spark, *cases).select("doc_id", responses.json_items(F.col("text")).alias("j"), responses.json_replacements(F.col("text")).alias("o"))
    rows = d.orderBy("doc_id").collect()
    assert rows[0]["j"]["items"][0]["find"] == "a" and rows[0]["j"]["error"] is None
    assert rows[1]["j"]["error"] == "no JSON array" and rows[2]["j"]["error"] == "invalid JSON"
    assert [x["find"] for x in rows[3]["o"]] == ["x"] and rows[1]["o"] == []


def test_requests_answers_and_resume(spark):
    prompts = files.read_prompts(spark, None, {"detector": "Find."})
    chunks = chunking.chunks(docs(spark, "one", "two"))
    r = requests.requests(chunks, prompts, "detect", "detector")
    assert r.where("doc_id = 0").first()["user"] == "<TEXT_TO_CORRECT>\none\n</TEXT_TO_CORRECT>"
    assert r.where("doc_id = 0").first()["stop"] == ["</RESULT>"]
    hinted = requests.with_hints(r, plan(spark, *((0, k, f"f{k}", "r") for k in range(30))))
    system = hinted.where("doc_id = 0").first()["system"]
    assert system.count('- "f') == 20 and '- "f0" → "r" (reason: x)' in system
    assert hinted.where("doc_id = 1").first()["system"] == "Find."

    def model(row):
        if row["doc_id"] == 1:
            raise TimeoutError("timeout")
        return "<RESULT>ones</RESULT>"

    answers = requests.answered(r, model, at_once=2)
    assert [x[0] for x in requests.unanswered(r, answers).select("doc_id").collect()] == [1]
    fixed = responses.rewritten(chunks, answers, ["doc_id", "chunk_no"], factor=1.5)
    got = {x["doc_id"]: x for x in fixed.collect()}
    assert got[0]["text"] == "ones" and got[1]["text"] == "two" and got[1]["reject"] == "timeout"
    s = {x["doc_id"]: x for x in stats.fixer_stats(fixed).collect()}
    assert s[1]["rejected_timeout"] == 1 and s[0]["spans_fixed"] == 1


def test_scrubbing(spark):
    story = [f"Paragraph {k} of the story goes on and on." for k in range(10)]
    blocks = ["A/N: thanks for reading this!", *story[:5], "A/N: a letter in the middle of it", *story[5:], "[Previous Chapter](a) [Next Chapter](b)", "Support me on Patreon for more!"]
    d = docs(spark, "\n\n".join(blocks), "A/N: Hi")
    c = scrub.candidates(scrub.blocks(d))
    got = {(r["doc_id"], r["text"][:12]): r for r in c.where("category is not null").collect()}
    assert got[(0, "A/N: thanks ")]["removed"] and got[(0, "[Previous Ch")]["reason"] == "navigation" and got[(0, "Support me o")]["reason"] == "promo_ad_social"
    assert got[(0, "A/N: a lette")]["reason"] == "kept_middle_bias" and not any(k[0] == 1 for k in got)
    out = {r["doc_id"]: r for r in scrub.scrubbed(c).collect()}
    assert out[0]["removed"] == 3 and out[0]["text"].startswith("Paragraph 0") and out[1]["text"] == "A/N: Hi"
    assert {r["doc_id"]: r["text"] for r in scrub.scrubbed(c, dry_run=True).collect()}[0] == "\n\n".join(blocks)
    assert scrub.appendix(c).count() == 3
    same = {r["doc_id"]: (r["text"], r["removed"]) for r in scrub.scrub(d).collect()}
    assert same == {k: (r["text"], r["removed"]) for k, r in out.items()}
    off = scrub.candidates(scrub.blocks(d), switches=("navigation",), kept_headings=("[Previous",))
    assert off.where("removed").count() == 0
    density = docs(spark, "see [one two](u) and [three](v) for the rest of it all", "none", "").select(scrub.link_density(F.col("text"))).collect()
    assert 0.2 < density[0][0] < 0.5 and density[1][0] == 0.0 == density[2][0]


def test_statistics(spark):
    out, s = clean.clean(docs(spark, "a    b !", "plain", None), ("prepass-basic",))
    assert {(r["doc_id"], r["key"], r["value"]) for r in s.collect()} == {(0, "spaces_collapsed", 1), (0, "space_before_punct", 1)}
    wide = stats.combined(s, ["spaces_collapsed", "space_after_punct"]).collect()
    assert len(wide) == 1 and wide[0]["spaces_collapsed"] == 1 and wide[0]["space_after_punct"] is None
    h = spark.createDataFrame([("low",)] + [("high",)] * 3 + [(None,)], "r string")
    assert [(r["r"], r["n"]) for r in stats.histogram(h, "r").collect()] == [("high", 3), ("low", 1)]
    g = stats.growth(spark.createDataFrame([("aaaa", "aaaaa")], "a string, b string"), [("p", "a", "b")]).first()
    assert (g["delta"], g["ratio"], g["shown"]) == (1, 0.25, "+25.00%")


def test_pipeline_protects_code(spark):
    t = "Look !!! `a    b !!!` and [x](http://a.b/c,d)   end"
    out, s = clean.clean(docs(spark, t))
    assert out.first()["text"] == "Look! `a    b !!!` and [x](http://a.b/c,d)  end"
    assert ("mask", "masks_created", 2) in {(r["step"], r["key"], r["value"]) for r in s.collect()}
    o = clean.Options(plan=plan(spark, (0, 0, "Look", "See")), validators={"max_ratio": 0.5})
    with pytest.warns(UserWarning, match="unknown step"):
        out, s = clean.clean(docs(spark, t), ("mask", "nonsense", "apply"), o)
    assert out.first()["text"].startswith("See !!! `a")


def test_evaluation(spark):
    pairs = evaluate.aligned_lines(docs(spark, "a\n\nb\nc"), docs(spark, " a \nx\nc\nd"))
    both = spark.createDataFrame([(0, "a\n\nb\nc", " a \nx\nc\nd")], "doc_id long, o string, e string")
    assert sorted(map(tuple, evaluate.paired_lines(both, "o", "e").collect())) == sorted(map(tuple, pairs.collect()))
    acc = evaluate.line_accuracy(pairs).first()
    assert (acc["same"], acc["total"], acc["accuracy"]) == (2, 4, 0.5)
    assert sorted((r["line_no"], r["sign"], r["line"]) for r in evaluate.changed_lines(pairs).collect()) == [(1, "+", "b"), (1, "-", "x"), (3, "-", "d")]
    m = evaluate.line_metrics(pairs).first()
    # Shares of the longer side's lines: three of the output, four of the expected text.
    assert (m["total"], m["differing"], m["exact"], m["fuzzy"], m["content"], m["headline"]) == (4, 2, 0.5, 0.5, 0.0, 0.5)
    near = "a line of text that is long enough"
    one, two = docs(spark, f"> {near}s\nplain\n> b"), docs(spark, f"other\n> {near}\n> quite another")
    pairs, quoted = evaluate.aligned_lines(one, two), evaluate.aligned_lines(one, two, lambda x: x.startswith(">"))
    for similarity in (evaluate.edit_similarity, evaluate.matching_ratio):
        m = evaluate.line_metrics(pairs, quoted, similarity=similarity).first()
        assert (m["total"], m["exact"], m["fuzzy"], m["content"], m["headline"]) == (3, 0.0, 0.0, 0.5, 0.5)
    t = spark.createDataFrame([("a\nb  c ", "a b c"), ("abcd", "abxd"), ("", "")], "a string, b string").select(evaluate.text_similarity(F.col("a"), F.col("b")))
    assert [r[0] for r in t.collect()] == [1.0, 0.75, 1.0]
    with pytest.raises(ValueError, match="variants"):
        evaluate.variants(docs(spark, "a"), spark.range(5), most=4)
    r = spark.createDataFrame([("hello world", "hallo wörld")], "a string, b string").select(evaluate.matching_ratio("a", "b")).first()[0]
    assert r == difflib.SequenceMatcher(None, "hello world", "hallo wörld").ratio()
    runs = spark.createDataFrame([(0, 10, "a", 0.5), (1, 20, "b", None), (2, 30, "a", 0.9), (3, 40, "b", 0.9)], "run_no int, ts long, variant string, similarity double").withColumn("ts", F.timestamp_seconds("ts"))
    assert [r["run_no"] for r in evaluate.ranked(runs).orderBy("rank").collect()] == [2, 3, 0, 1]
    assert evaluate.best_run(runs).first()["run_no"] == 2
    assert [r["run_no"] for r in evaluate.last_runs(runs, 2).collect()] == [3, 2]
    change = {r["run_no"]: r["change"] for r in evaluate.improvement(runs, ["variant"]).collect()}
    assert change[2] == pytest.approx(0.4) and change[0] is None and change[3] is None
    assert evaluate.compared(runs, "variant", "a", "b", ["similarity"]).first()["better"] == "b"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("line one\nline two")
    d = files.read_texts(spark, str(tmp_path / "in"))
    assert d.first()["text"] == "line one\nline two"
    files.write_documents(d.withColumn("lang", F.lit("en")), str(tmp_path / "out"), ["lang"])
    assert spark.read.parquet(str(tmp_path / "out")).first()["lang"] == "en"
    s = spark.createDataFrame([(1, "mask", "masks_created", 2)], "doc_id long, step string, key string, value long")
    files.write_stats(s, str(tmp_path / "stats"))
    assert files.read_stats(spark, str(tmp_path / "stats")).collect() == s.collect()
    (tmp_path / "plan.json").write_text('[\n {"find": "a", "replace": "b", "reason": "r"},\n {"find": "c", "replace": "d"}\n]')
    assert [(r["item_no"], r["find"], r["reason"]) for r in files.read_plan(spark, str(tmp_path / "plan.json")).orderBy("item_no").collect()] == [(0, "a", "r"), (1, "c", "unknown")]
    (tmp_path / "prompts.json").write_text('{"detector": "own"}')
    assert {r["key"]: r["prompt"] for r in files.read_prompts(spark, str(tmp_path / "prompts.json"), {"detector": "d", "grammar": "g"}).collect()} == {"detector": "own", "grammar": "g"}
    (tmp_path / "words.txt").write_text("NASA\n\n BLUH \n")
    assert [r["word"] for r in files.read_lexicon(spark, str(tmp_path / "words.txt"), "acronym").collect()] == ["NASA", "BLUH"]
    (tmp_path / "runs.json").write_text('{"results": [{"timestamp": "20251012_014825", "variant": "v1", "similarity": 51.85}, {"timestamp": "2025-10-24T21:52:46", "variant": "v2", "similarity": 53.37}]}')
    runs = files.read_runs(spark, str(tmp_path / "runs.json"))
    assert [str(r["ts"]) for r in runs.orderBy("run_no").collect()] == ["2025-10-12 01:48:25", "2025-10-24 21:52:46"]
    assert evaluate.best_run(runs).first()["variant"] == "v2"
    (tmp_path / "runs2.json").write_text('{"results": [{"timestamp": "20251101_000000", "variant": "v3", "similarity": 53.37}]}')
    both = files.read_runs(spark, str(tmp_path / "runs*.json"))
    assert [(r["run_no"], r["variant"]) for r in both.orderBy("run_no").collect()] == [(0, "v1"), (1, "v2"), (2, "v3")]
    assert evaluate.best_run(both).first()["variant"] == "v2"


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    d = docs(spark, *(f"text {k} !!! a    b" for k in range(10)))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    go = lambda: incremental.clean_stream(incremental.arriving(spark, source, d.schema), out, state, ("prepass-basic",)).awaitTermination()
    d.where("doc_id < 5").write.parquet(source)
    go()
    go()
    assert spark.read.parquet(out).count() == 5
    d.where("doc_id >= 5").write.mode("append").parquet(source)
    go()
    batch, _ = clean.clean(d, ("prepass-basic",))
    assert sorted(map(tuple, spark.read.parquet(out).select("doc_id", "text").collect())) == sorted(map(tuple, batch.select("doc_id", "text").collect()))


def test_stream_sums_by_hour(spark, tmp_path):
    rows = [(0, "s", "k", 1, "2025-01-01 10:00:00"), (1, "s", "k", 2, "2025-01-01 15:00:00"), (2, "s", "k", 4, "2025-01-01 10:30:00")]
    d = spark.createDataFrame(rows, "doc_id long, step string, key string, value long, ts string").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = incremental.arriving(spark, str(tmp_path / "in"), d.schema)
    out = incremental.drain(incremental.running_stats(s), "hour_sums", "complete")
    assert {str(r["hour"]): r["total"] for r in out.collect()} == {"2025-01-01 10:00:00": 5, "2025-01-01 15:00:00": 2}


def test_json_answers_of_any_length(spark, tmp_path):
    from loomtext import queries

    long = " ".join("WORD" + chr(65 + k % 26) * 60 for k in range(40))
    spark.createDataFrame([(1, long, "en", "s"), (2, "FIVES only", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r["doc_id"], r["item_no"], r["find"], r["replace"]) for r in queries.plan(spark, str(tmp_path)).collect())
    get = lambda f: sorted((r["doc_id"], r["item_no"], r["find"], r["replace"]) for r in f(spark, str(tmp_path)).collect())
    assert len(want) > 40 and get(queries.parse_json_whole) == want
    assert get(queries.parse_json) == [r for r in want if r[1] < 10]


def test_dictionaries_of_any_size_give_the_same(spark):
    d = docs(spark, "the cat sat", "the cat sat", "a dog", "", None, "öx the").withColumn("doc_id", F.when(F.col("doc_id") < 2, 7).otherwise(F.col("doc_id")))
    entries = [(0, "the"), (1, "cat sat"), (2, "a"), (3, "dog"), (4, "ö"), (5, "ox"), (6, "öx"), (7, "zzzz"), (8, ""), (9, "the ")]
    e = spark.createDataFrame([(n, f, "r", "x") for n, f in entries], "item_no int, find string, replace string, reason string")
    small, large = (sorted(map(tuple, apply.dictionary_hits(d, e, most).collect())) for most in (100, 1))
    assert small == large and len(small) == 2 * 4 + 2 + 3 and [r[:2] for r in small if r[0] == 2] == [(2, 2), (2, 3)]


def test_rules_have_categories(spark):
    rules = [("MORFOLOGIK_RULE_EN", "x"), ("WHITESPACE_RULE", None), ("COMMA_RULE", "x"), ("UPPERCASE_SENTENCE_START", "x"), ("UNKNOWN_RULE", "Unknown"), ("X", "Possible Spelling Mistake"), ("Y", "Casing")]
    d = spark.createDataFrame(rules, "rule string, kind string").select(apply.rule_category(F.col("rule"), F.col("kind")))
    assert [r[0] for r in d.collect()] == ["TYPOS", "SPACING", "PUNCTUATION", "CASING", None, "TYPOS", "CASING"]


def test_short_nodes_and_reverted_documents(spark):
    nodes = spark.createDataFrame([(1, 0, "x" * 100), (1, 1, "short"), (2, 0, "y" * 100), (2, 1, "z" * 400)], "doc_id long, chunk_no int, text string")
    answers = [(1, 0, "x" * 110, None), (1, 1, "longer than before", None), (2, 0, "y" * 103, None), (2, 1, None, "TimeoutError: timeout")]
    said = spark.createDataFrame(answers, "doc_id long, chunk_no int, response string, error string")
    done = responses.rewritten(nodes, said, ["doc_id", "chunk_no"], least=20)
    got = {(r["doc_id"], r["chunk_no"]): (len(r["text"]), r["fixed"], r["reject"]) for r in done.collect()}
    assert got == {(1, 0): (110, True, None), (1, 1): (5, None, None), (2, 0): (103, True, None), (2, 1): (400, False, "timeout")}
    back = {(r["doc_id"], r["chunk_no"]): (len(r["text"]), r["reverted"]) for r in responses.with_reverted(done).collect()}
    assert back == {(1, 0): (100, True), (1, 1): (5, True), (2, 0): (103, False), (2, 1): (400, False)}
    s = {r["doc_id"]: r for r in stats.fixer_stats(done).collect()}
    assert (s[1]["nodes_seen"], s[1]["spans_total"], s[1]["spans_fixed"], s[1]["file_growth_ratio"]) == (2, 1, 1, 10 / 105)
    assert (s[2]["spans_total"], s[2]["spans_rejected"], s[2]["rejected_timeout"], s[2]["file_growth_ratio"]) == (2, 1, 1, 3 / 500)
    kinds = spark.createDataFrame([("text", "a" * 51), ("text", " " * 9 + "a" * 50), ("code", "a" * 90)], "k string, t string")
    assert [r[0] for r in kinds.select(responses.worth_correcting(F.col("k"), F.col("t"))).collect()] == [True, False, False]


def test_calls_have_a_time_limit_and_answers_stay(spark, tmp_path):
    def slow(row):
        import time

        time.sleep(30 if row["chunk_no"] == 1 else 0)
        return f"said {row['chunk_no']}"

    asked = spark.createDataFrame([(1, n, "detect", "s", "u") for n in range(3)], "doc_id long, chunk_no int, phase string, system string, user string")
    got = requests.stored_answers(asked, slow, str(tmp_path / "a"), tries=1, seconds=2.0)
    assert {(r["chunk_no"], r["response"], r["error"]) for r in got.collect()} == {(0, "said 0", None), (1, None, "TimeoutError: timeout after 2.0 s"), (2, "said 2", None)}
    again = requests.stored_answers(asked, lambda row: "late", str(tmp_path / "a"), tries=1)
    assert {(r["chunk_no"], r["response"], r["error"]) for r in again.collect()} == {(0, "said 0", None), (1, "late", None), (2, "said 2", None)}


def test_policies_switched_off(spark):
    out, s = clean.clean(docs(spark, "LOUD words!!!"), ("policies",), clean.Options(policies=False))
    assert out.first()["text"] == "LOUD words!!!" and [tuple(r) for r in s.collect()] == [(0, "policies", "prepass_advanced_disabled", 1)]


def test_lexicons_are_bounded(spark):
    from loomtext.functions import text

    d = spark.createDataFrame([("NASA",), ("BLUH",), ("NASA",), (None,)], "word string")
    assert text.kept_words(d) == ["BLUH", "NASA"]
    with pytest.raises(ValueError, match="lexicon"):
        text.kept_words(d, most=1)
