import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.operators import inference
from loomtext.operators.responses import END, START
from loomtext.plans import clean, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this module
QUICK = inference.Pool(tries=1, wait=0.0, tasks=2)


def text_of(row):
    return row["user"][len(START) + 1 : -len(END) - 1]


def logged(path, answer):
    """A stand-in that notes each of its calls in a file of its own."""

    def complete(row):
        import uuid

        (path / uuid.uuid4().hex).write_text(json.dumps([row["phase"], text_of(row)]))
        return answer(row)

    return complete


def calls(path):
    return sorted(tuple(json.loads(f.read_text())) for f in path.iterdir())


def answer(row):
    t = text_of(row)
    if row["phase"] == "detect":
        return "FIND: teh\nREPLACE: the\nREASON: typo\n---\nFIND: not there\nREPLACE: x\n---\nFIND: teh\nREPLACE: the\nREASON: again"
    if row["phase"] == "grammar":
        return f"<think>x</think><RESULT> {t.replace('go', 'goes')} </RESULT>"
    return t + ("!" if "cat" in t else " much too long" * len(t))


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, answers string").repartition(3)


ROWS = [(1, "teh cat `code` and teh dog go home"), (2, "a bird"), (None, "teh cat `code` and teh dog go home"), (2, None), (3, ""), (4, "   \n"), (1, "another teh text with number one")]
STEPS = ("mask", "detect", "apply", "grammar", "fix")


def test_all_steps(spark, tmp_path):
    model = whole.Model(answer, str(tmp_path / "run"), pool=QUICK)
    out, stats = whole.clean_everything(docs(spark, ROWS), model, STEPS, clean.Options(validators={"max_ratio": 0.5}))
    assert set(out.columns) == {"doc_id", "text", "answers"}
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    first = "the cat `code` and teh dog goes home!"  # the plan has each pair once, and applies to the first occurrence
    assert got == sorted([(1, first), (2, "a bird"), (None, first), (2, None), (3, ""), (4, "   \n"), (1, "another the text with number one")], key=repr)
    s = {(r.step, r.key): r.v for r in stats.groupBy("step", "key").agg(F.sum("value").alias("v")).collect()}
    assert s["detect", "suggestions_valid"] == 6 and s["detect", "suggestions_rejected"] == 6 and s["detect", "plan_size"] == 3
    assert s["apply", "replacements_applied"] == 3 and s["apply", "skipped"] == 4 and s["grammar", "problems_provided"] == 3
    assert s["detect", "model_calls"] == 4 and s["fix", "polishing_calls"] == 2 and s["mask", "masks_created"] == 2


def test_equal_requests_are_asked_once(spark, tmp_path):
    noted = tmp_path / "calls"
    noted.mkdir()
    model = whole.Model(logged(noted, answer), str(tmp_path / "run"), pool=QUICK)
    out, _ = whole.clean_everything(docs(spark, [(k, "teh same text") for k in range(30)]), model, ("detect", "apply"))
    assert {r.text for r in out.collect()} == {"the same text"}
    assert calls(noted) == [("detect", "teh same text")]


def test_resumed_after_a_failed_model_phase(spark, tmp_path):
    """The grammar model fails on some: run again with the same folder, only those are asked, and nothing before them."""
    noted = tmp_path / "calls"
    noted.mkdir()

    def failing(row):
        if row["phase"] == "grammar" and "dog" in row["user"]:
            raise TimeoutError("timeout")
        return answer(row)

    def run(answer, folder):
        model = whole.Model(logged(noted, answer), str(tmp_path / folder), pool=QUICK)
        return sorted(((r.doc_id, r.text) for r in whole.clean_everything(docs(spark, ROWS), model, ("detect", "grammar"))[0].collect()), key=repr)

    first = run(failing, "run")
    assert any("dog go home" in (t or "") for _, t in first)
    for f in noted.iterdir():
        f.unlink()
    again = run(answer, "run")
    assert {p for p, _ in calls(noted)} == {"grammar"} and len(calls(noted)) == 1
    assert again == run(answer, "fresh") and any("dog goes home" in (t or "") for _, t in again)


def test_fix_by_pieces_reverts_documents_that_grow(spark, tmp_path):
    short, long = "One cat sat on a mat here. " * 30, "One dog ran off to town. " * 30

    def grow(row):
        t = text_of(row)
        return t + " and more" if "cat" in t else t.replace("ran", "run")

    model = whole.Model(grow, str(tmp_path / "run"), pool=QUICK, nodes=60)
    out, stats = whole.clean_everything(docs(spark, [(1, short), (2, long), (3, "tiny"), (4, None)]), model, ("fix",))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: short, 2: long.replace("ran", "run"), 3: "tiny", 4: None}
    s = {(r.doc_id, r.key): r.value for r in stats.collect()}
    assert s[1, "reverted"] == 1 and (2, "reverted") not in s
    assert s[2, "nodes_seen"] == s[2, "spans_fixed"] == 15 and s[3, "nodes_seen"] == 1 and s[3, "spans_total"] == 0


def test_scrubber_unknown_steps_and_no_model(spark, tmp_path):
    text = "Previous chapter | Next chapter\n\nThe story itself.\n\nIt goes on.\n\nSupport me on Patreon please"
    with pytest.warns(UserWarning, match="unknown step"):
        out, stats = whole.clean_everything(docs(spark, [(1, text)]), None, ("scrubber", "no such"))
    assert [r.text for r in out.collect()] == ["The story itself.\n\nIt goes on."]
    assert [(r.step, r.key, r.value) for r in stats.collect()] == [("scrubber", "blocks_removed", 2)]
    with pytest.raises(ValueError):
        whole.clean_everything(docs(spark, [(1, text)]), None)
    assert whole.clean_everything(docs(spark, ROWS).where("false"), whole.Model(answer, str(tmp_path / "none"), pool=QUICK), STEPS[1:])[0].collect() == []


def asked(spark, n):
    rows = spark.createDataFrame([(f"text {k}",) for k in range(n)], "text string")
    return inference.distinct_requests(inference.keyed(rows, "detect", F.lit("Find."), F.col("text")))


def test_calls_run_beside_each_other(spark):
    def slow(row):
        time.sleep(0.05)
        return text_of(row)

    reqs = asked(spark, 200).cache()
    reqs.count()
    began = time.time()
    got = inference.called(reqs, slow, inference.Pool(under_way=8, tasks=1)).collect()
    assert time.time() - began < 200 * 0.05 / 3 and sorted(r.response for r in got) == sorted(f"text {k}" for k in range(200))


def test_waits_grow_and_calls_keep_apart():
    at, pool = [], inference.Pool(tries=4, wait=0.1, seconds=None)

    def fails(row):
        at.append(time.monotonic())
        raise ConnectionError("refused")

    assert inference.patiently({"digest": "d"}, fails, pool, inference.Gate(0.0)) == ("d", None, "ConnectionError: refused", 4)
    waits = [b - a for a, b in zip(at, at[1:])]
    assert waits[0] >= 0.1 and waits[1] >= 0.2 and waits[2] >= 0.4
    gate, times = inference.Gate(0.05), []
    threads = [threading.Thread(target=lambda: (gate.enter(), times.append(time.monotonic()))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    times.sort()
    assert times[-1] - times[0] >= 0.24


def test_stored_in_waves_and_asked_again_only_for_errors(spark, tmp_path):
    reqs = asked(spark, 40)
    pool = inference.Pool(tries=1, tasks=2, waves=3)

    def some(row):
        if text_of(row).endswith("3"):
            raise TimeoutError("timeout")
        return "first"

    def rest(row):
        return "second"

    folder = str(tmp_path / "answers")
    one = inference.answers(reqs, some, folder, pool).collect()
    assert sorted((r.response or "", r.error or "", r.calls) for r in one) == [("", "TimeoutError: timeout", 1)] * 4 + [("first", "", 1)] * 36
    two = inference.answers(reqs, rest, folder, pool).collect()
    assert sorted((r.response, r.error, r.calls) for r in two) == [("first", None, 1)] * 36 + [("second", None, 2)] * 4


def test_calls_of_a_thread_share_a_helper_until_one_hangs():
    from loomtext.operators.requests import within

    name = lambda row: threading.current_thread().name
    first = {within(5.0, name, {}) for _ in range(50)}
    assert len(first) == 1  # a thread for each call cost more than most stand-ins
    with pytest.raises(TimeoutError):
        within(0.05, lambda row: time.sleep(0.5), {})
    with pytest.raises(ValueError):
        within(5.0, lambda row: int("x"), {})
    assert within(5.0, name, {}) not in first


def test_chunks_meet_answers_once_and_texts_without_items_stay_out_of_python(spark, tmp_path):
    """One join of the chunks with their answers (there were two, each with all chunks cut and hashed anew)."""
    model = whole.Model(answer, str(tmp_path / "run"), pool=QUICK)
    d = whole.detect(docs(spark, ROWS), clean.Options(), model, "0-detect")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(CASE WHEN (length(text") == 1
    d = d.select("_row", F.size("_plan").alias("n"), "`detect.model_calls`").collect()
    assert sorted(tuple(r)[1:] for r in d) == [(0, 0), (0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]


def test_statistics_of_the_last_step_move_no_texts(spark, tmp_path):
    model = whole.Model(answer, str(tmp_path / "run"), pool=QUICK)
    _, stats = whole.clean_everything(docs(spark, ROWS), model, ("mask", "fix"))
    plan = stats.groupBy("step", "key").agg(F.sum("value").alias("v"))
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    both = tree[tree.index("Join") :].split("\n")[1:]  # what is projected on either side of the join
    sides = [line for line in both if "Project [" in line]
    assert len(sides) == 2 and not any(", text#" in line or "[text#" in line or "AS _said" in line for line in sides), tree
    assert {(r.step, r.key): r.v for r in plan.collect()} == {("mask", "masks_created"): 2, ("fix", "polishing_calls"): 2}
