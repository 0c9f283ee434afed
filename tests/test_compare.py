import random
from collections import defaultdict

import pytest

from traceloom import modes
from traceloom.operators import compare
from traceloom.sources import sinks

LINES = "task string, line_no int, value string"


def lines(spark, **tasks):
    return spark.createDataFrame([(t, i + 1, v) for t, vs in tasks.items() for i, v in enumerate(vs)], LINES)


@pytest.mark.parametrize(
    "truth,pred,want",
    [
        (["a", "b"], ["a"], ("partial_same", 1, 2, 1, 0, [2])),
        (["a"], ["a", "b", "c"], ("full_same", 1, 1, 0, 2, [])),
        (["a"], ["b"], ("all_diff", 0, 1, 0, 0, [1])),
        (["a", None], ["a", None], ("full_same", 2, 2, 0, 0, [])),
        ([None], [], None),
    ],
)
def test_edge_rows(spark, truth, pred, want):
    got = compare.compare_outputs(lines(spark, t=truth), lines(spark, t=pred), ["task"]).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if want else [])


def test_sentinels_empty_and_missing_files(spark):
    truth = lines(spark, a=["x", "y"], b=["x"]).selectExpr("*", "task <> 'a' AS is_valid")
    pred = lines(spark, a=["x", "y", "z"], c=["x"], d=["x"])
    known = spark.createDataFrame([("a",), ("b",), ("d",)], "task string")
    got = {r.task: r for r in compare.compare_outputs(truth, pred, ["task"], truth_tasks=known).collect()}
    assert got["a"].status == "no_valid_cases" and got["a"].extra_lines == 1 and got["a"].total_count == 0
    assert got["c"].status == "missing_file" and got["c"].extra_lines == 0
    assert got["d"].status == "no_valid_cases" and got["d"].extra_lines == 1
    assert set(got) == {"a", "c", "d"}
    everything = compare.compare_outputs(truth, pred, ["task"], truth_tasks=known, include_unpredicted=True)
    assert {r.task: r.status for r in everything.collect()}["b"] == "all_diff"
    total = compare.summarize(compare.compare_outputs(truth, pred, ["task"], truth_tasks=known), []).first()
    assert (total.task_count, total.valid_task_count, total.missing_file_tasks, total.no_valid_case_tasks, total.extra_output_lines, total.accuracy) == (3, 0, 1, 2, 0, 0.0)


def test_against_plain_python(spark):
    rng = random.Random(2)
    truth = {f"t{i}": [rng.choice("abc") for _ in range(rng.randrange(1, 7))] for i in range(40)}
    pred = {f"t{i}": [rng.choice("abc") for _ in range(rng.randrange(1, 7))] for i in range(5, 45)}
    got = {r.task: r for r in compare.compare_outputs(lines(spark, **truth), lines(spark, **pred), ["task"]).collect()}
    assert set(got) == set(pred)
    for t, p in pred.items():
        if t not in truth:
            assert got[t].status == "missing_file"
            continue
        o = truth[t]
        diff = [i + 1 for i, v in enumerate(o) if i >= len(p) or p[i] != v]
        assert got[t].diff_lines == diff and got[t].same_count == len(o) - len(diff)
        assert got[t].missing_lines == max(0, len(o) - len(p)) and got[t].extra_lines == max(0, len(p) - len(o))
    first = {r.task: r for r in compare.first_cases(lines(spark, **truth), lines(spark, **pred), lines(spark, **{t: ["in0"] for t in truth}), ["task"]).collect()}
    for t, p in pred.items():
        same = next((i + 1 for i, v in enumerate(truth.get(t, [])) if i < len(p) and p[i] == v), None)
        assert first[t].same_line == same and first[t].correct_input == (None if same is None else "in0" if same == 1 else "")
    both = sinks.first_case_columns(compare.first_cases(lines(spark, **truth), lines(spark, **pred), lines(spark), ["task"]))
    assert {r.status for r in both.collect()} == {"correct", "error"}


def test_null_rules_differ(spark):
    a, b = lines(spark, t=["a"]), lines(spark, t=["a", ""])
    compared = {r.line_no: (r.value, r.is_valid) for r in compare.compare_lines(a, b, ["task"]).collect()}
    assert compared == {1: ("a", False), 2: ("", False)}
    shown = compare.examples(["task"], 3, a, lines(spark, t=["i", "j"]), b).collect()
    assert [(r.line_no, r.original, r.mutated, r.input) for r in shown] == [(2, None, "", "j")]
    assert compare.examples(["task"], 3, a, lines(spark, t=["i", "j"]), lines(spark, t=["a"])).count() == 0
    summary = compare.compare_summary(compare.compare_lines(a, b, ["task"]), [], ["task"]).first()
    assert (summary.same_cases, summary.total_cases, summary.fully_same_tasks, summary.same_ratio) == (2, 2, 1, 1.0)


def test_validators(spark):
    original, mutant = lines(spark, a=["1", "2"], b=["1"], c=["1"]), lines(spark, a=["1", "2"], b=["2"])
    verdicts = compare.validate(original, mutant, ["task"], equivalent=True)
    assert {r.task: r.reason for r in verdicts.collect()} == {"a": "passed", "b": "different_result", "c": "missing_result"}
    assert tuple(compare.validation_summary(verdicts, []).first()) == (3, 1, 2, 1)
    assert [r.task for r in compare.failures(verdicts).collect()] == ["b"] and compare.failures(verdicts, True).count() == 2
    assert {r.task: r.reason for r in compare.validate(original, mutant, ["task"], equivalent=False).collect()} == {"a": "same_result", "b": "passed", "c": "missing_result"}


def test_problem_tasks_and_resume(spark):
    tasks = spark.createDataFrame([(t,) for t in "abcd"], "task string")
    compared = spark.createDataFrame([("c", False), ("c", False), ("d", False), ("d", True)], "task string, is_valid boolean")
    found = compare.problem_tasks(tasks, lines(spark, b=["1"], c=["1"], d=["1"]), compared, ["task"])
    assert {r.task: r.problem for r in found.collect()} == {"a": "failed_or_timeout", "b": "empty_compare", "c": "fully_same"}
    assert [r.task for r in compare.missing_from(tasks, lines(spark, b=["1"], c=["1"], d=["1"]), ["task"]).collect()] == ["a"]
    wanted = spark.createDataFrame([("a", "1"), ("b", None), ("z", "1"), ("c", "2")], "task string, value string")
    got = compare.audit(lines(spark, a=["1"], b=["1"], c=["1"]), wanted, ["task"], "value")
    assert {r.task: r.verdict for r in got.collect()} == {"a": "same", "b": "diff", "z": "missing", "c": "diff"}


def test_modes(spark):
    assert modes.modes(spark).count() == 3 and modes.selected("error", modes.STATUSES) == ["error"]
    with pytest.raises(ValueError):
        modes.selected("other", modes.MODES)
    assert modes.job_matrix(spark.range(2), status="correct").count() == 6


def test_report(spark):
    tally = compare.compare_outputs(lines(spark, b=["1"], a=["1"]), lines(spark, a=["1"], b=["2"]), ["task"]).selectExpr("'m' AS mode", "task AS task_id", "status", "same_count", "total_count", "missing_lines", "extra_lines")
    (doc,) = sinks.json_report(compare.summarize(tally, ["mode"]), tally, ["mode"]).collect()
    assert [t.task_id for t in doc.tasks] == ["a", "b"] and doc.summary.accuracy == 0.5


def test_agreement(spark):
    got = compare.agreement(lines(spark, a=["1", "2"], b=["1"]), lines(spark, a=["1", "3"], b=["1", "2"]), ["task"]).collect()
    assert [(r.task, r.equal_lines, r.lines, r.fully_same) for r in got] == [("a", 1, 2, False)]
    assert defaultdict(int)["x"] == 0
