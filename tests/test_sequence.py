import math
import random

import pytest
from pyspark.sql import functions as F

from traceloom.functions import similarity
from traceloom.operators import rollup, sequence


def events(spark, values, kind="string"):
    return spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], f"run string, step long, value {kind}")


def kept(df, column="value"):
    return [r[column] for r in df.orderBy("step").collect()]


def test_changes(spark):
    assert kept(sequence.changes(events(spark, [None, None, "1", "1", None]), ["run"], "step", "value")) == [None, "1", None]
    assert kept(sequence.changes(events(spark, ["nan", "nan", "1"]), ["run"], "step", "value")) == ["nan", "nan", "1"]
    got = kept(sequence.changes(events(spark, [1.0, math.nan, math.nan, 1.0, 1.0], "double"), ["run"], "step", "value"))
    assert [str(x) for x in got] == ["1.0", "nan", "nan", "1.0"]


def test_variable_filter(spark):
    rows = spark.createDataFrame([("__x", "value"), ("inputs", "value"), ("inp", "value"), ("f", "callable"), ("m", "module"), ("ok", "value"), ("k", None)], "var string, kind string")
    assert [r["var"] for r in sequence.traced(rows).collect()] == ["ok", "k"]


def plain_trace(blocks, values, cap, most):
    path, vals, pairs, now, last, n = [], [], [], None, object(), 0
    for b, v in zip(blocks, values):
        n += 1
        if n > most or b is None or b == now:
            continue
        now = b
        if len(path) >= cap:
            if path[-1] != "TRUNCATED":
                path.append("TRUNCATED")
            continue
        path.append(b)
        pairs.append((b, str(v)))
        if not vals or str(v) != last:
            vals.append(str(v))
            last = str(v)
    return path, vals, pairs


@pytest.mark.parametrize("cap,most,n", [(500, 5000, 1100), (5, 5000, 60), (7, 12, 60)])
def test_block_traces(spark, cap, most, n):
    rng = random.Random(cap)
    blocks = [rng.choice(["A", "B", "C", None]) for _ in range(n)]
    values = [rng.choice([None, "1", "2"]) for _ in range(n)]
    rows = spark.createDataFrame([("r", i, b, v) for i, (b, v) in enumerate(zip(blocks, values))], "run string, step long, block string, value string")
    got = sequence.block_traces(rows, ["run"], "step", "block", "value", cap, most).first()
    want = plain_trace(blocks, values, cap, most)
    assert (got.block_sequence, got["values"], [tuple(p) for p in got.paired]) == want
    steps = sequence.capped(sequence.block_steps(rows, ["run"], "step", "block", most), ["run"], "block", cap)
    assert [r.block for r in steps.orderBy("path_no").collect()] == want[0]


def test_truncation_at_501(spark):
    rows = spark.createDataFrame([("r", i, "AB"[i % 2], "x") for i in range(501)], "run string, step long, block string, value string")
    got = sequence.block_traces(rows, ["run"], "step", "block", "value").first().block_sequence
    assert len(got) == 501 and got[-1] == "TRUNCATED"


def test_deltas_and_writes(spark):
    rows = spark.createDataFrame([("f", 1, "a", "1"), ("f", 1, "b", "1"), ("f", 2, "a", "1"), ("f", 2, "b", "2"), ("g", 3, "a", "1")], "frame string, step long, var string, value string")
    assert {(r.frame, r.step): r.changes for r in sequence.deltas(rows, ["frame"], "step").collect()} == {("f", 1): {"a": "1", "b": "1"}, ("f", 2): {"b": "2"}, ("g", 3): {"a": "1"}}
    assert {r["var"]: r["values"] for r in sequence.writes(rows, ["frame"], "step", "var", "value").where("frame = 'f'").collect()} == {"a": ["1", "1"], "b": ["1", "2"]}


def test_range_blocks(spark):
    points = spark.createDataFrame([(i,) for i in range(-3, 40)], "at int")
    spans = spark.createDataFrame([("a", 0, 3), ("b", 2, 30), ("c", 31, 31)], "block string, low int, high int")
    got = sorted((r.at, r.block) for r in sequence.range_blocks(points, spans, "at", "low", "high", 8).collect())
    assert got == sorted((i, b) for i in range(-3, 40) for b, lo, hi in (("a", 0, 3), ("b", 2, 30), ("c", 31, 31)) if lo <= i <= hi)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_class(t, p, tv, pv):
    if t == p:
        return "PERFECT" if tv == pv else "PATH_OK_VALUE_ERR"
    if set(t) == set(p):
        return "WRONG_ITER_COUNT" if len(t) != len(p) else "WRONG_ORDER"
    if set(p) - set(t):
        return "WRONG_BRANCH"
    return "EARLY_TERMINATION" if len(p) < len(t) else "MIXED_ERROR"


def test_scores_match_plain_python(spark):
    rng = random.Random(3)
    draw = lambda names, n: [rng.choice(names) for _ in range(rng.randrange(n))]
    rows = [(draw(["B0", "B1", "B10", "é"], 9), draw(["B0", "B1", "B10", "B2"], 9), draw("123", 6), draw("123", 6)) for _ in range(250)]
    rows += [([], [], [], []), (["x"], [], [], ["1"]), (["A", "B"], ["A", "A"], [], []), (["A", "B", "C"], ["A", "B"], ["1"], ["1"]), (["A", "B"], ["A", "B"], ["1", None], ["1"])]
    rows += [([str(i) for i in range(3000)], [str(i) for i in range(1, 3001)], ["1"], ["1"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, truth_path array<string>, pred_path array<string>, truth_values array<string>, pred_values array<string>")
    for r in similarity.score_pairs(df).collect():
        t, p, tv, pv = rows[r.i]
        d = plain_distance(t, p)
        assert r.distance == d
        assert r.block_similarity == pytest.approx(1 - d / max(len(t), len(p)) if t or p else 1.0)
        want = sum(i < len(pv) and tv[i] == pv[i] for i in range(len(tv))) / len(tv) if tv else float(not pv)
        assert r.value_accuracy == pytest.approx(want)
        assert r.error_type == plain_class(t, p, tv, pv)
        final = bool(tv and pv and tv[-1] is not None and tv[-1] == pv[-1])
        assert r.final_correct == final and r.reasoning_illusion == (final and t != p)


def test_variable_scores(spark):
    truth = spark.createDataFrame([("a", "result", "1"), ("a", "x", "2"), ("a", "y", "3"), ("b", "x", "1"), ("c", "result", "1")], "task string, var string, value string")
    pred = spark.createDataFrame([("a", "result", "1"), ("a", "x", "9"), ("b", "result", "1"), ("c", "result", "2"), ("d", "result", "1")], "task string, var string, value string")
    got = {r.task: tuple(r)[1:] for r in rollup.variable_scores(truth, pred, ["task"]).collect()}
    assert got == {"a": (False, 2, 1, True, False), "b": (True, 0, 0, False, False), "c": (False, 1, 0, False, False)}
    rows = rollup.variable_scores(truth, pred, ["task"]).withColumn("label", F.lit("l"))
    total = {r.label: r for r in rollup.variable_rollup(rows, "label").collect()}["total"]
    assert (total.valid_files, total.skipped_files, total.vars_matched, total.vars_compared, total.result_rate) == (2, 1, 1, 3, 0.5)


def test_rounded_rollup(spark):
    rows = spark.createDataFrame([("a", 0.33333, 1.0, 3), ("b", 0.5, 0.25, 1), ("total", 0.0, 0.0, 4)], "label string, avg_similarity double, avg_value_accuracy double, files long")
    got = rollup.rounded_rollup(rows).first()
    assert got.files == 4 and got.avg_similarity == pytest.approx((0.3333 * 3 + 0.5) / 4) and got.avg_value_accuracy == pytest.approx((3 + 0.25) / 4)


def test_sampled_is_stable(spark):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id")
    one = sorted(r.id for r in sequence.sampled(rows, ["k"], "id", 4, 1).collect())
    assert one == sorted(r.id for r in sequence.sampled(rows.repartition(7), ["k"], "id", 4, 1).collect()) and len(one) == 12
    assert one != sorted(r.id for r in sequence.sampled(rows, ["k"], "id", 4, 2).collect())
