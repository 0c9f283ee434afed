"""Exact rounding, long edit distances, innermost spans, literals as values: each against plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceloom.functions import numbers, similarity
from traceloom.operators import programs, sequence


@pytest.mark.parametrize("places", [0, 2, 4])
def test_rounding_is_pythons(spark, places):
    rng = np.random.default_rng(places)
    n = 350_000
    near = (rng.integers(-(10**9), 10**9, n) + 0.5) / 10**places  # as near to a tie as doubles get
    dyadic = rng.integers(-(10**6), 10**6, n) / 2.0 ** rng.integers(0, 20, n)  # real ties
    wide = rng.standard_normal(n) * 10.0 ** rng.integers(-12, 18, n)
    edge = np.array([0.00625, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -0.0, 0.0, 5e-324, -5e-324, 2.0**52, 2.0**53, 4.5e11 + 0.25, 5.4e11 + 0.00005, 4503599627370497.5 / 10**places, 1e308, -1e308, math.inf, -math.inf])
    x = np.concatenate([near, np.nextafter(near, 0), dyadic, wide, edge])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", numbers.rounded(F.col("x"), places).alias("y")).toPandas()
    want = np.array([v if math.isinf(v) else float(round(v, places)) for v in got["x"].tolist()])
    wrong = (got["y"].to_numpy() != want) | (np.signbit(got["y"].to_numpy()) != np.signbit(want))
    assert not wrong.any(), list(zip(got["x"][wrong][:5], got["y"][wrong][:5], want[wrong][:5]))


def test_rounding_of_null_and_nan(spark):
    rows = spark.sql("SELECT cast(NULL AS double) AS x, cast('NaN' AS double) AS y, 2 AS z").select(*[numbers.rounded(F.col(c), 3) for c in "xyz"]).collect()
    assert rows[0][0] is None and math.isnan(rows[0][1]) and rows[0][2] == 2.0
    with pytest.raises(ValueError):
        numbers.rounded(F.lit(1.0), 16)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_distance(monkeypatch):
    rng = random.Random(2)
    for trial in range(200):
        monkeypatch.setattr(similarity, "MASK_BYTES", rng.choice([1, 64 << 20]))
        a, b = ([rng.choice([None, "x", "yy", 3][: rng.randrange(2, 5)]) for _ in range(rng.randrange(90))] for _ in range(2))
        assert similarity.bit_distance(a, b) == plain_distance(a, b)


@pytest.mark.parametrize("long", [0, 100, 1_000_000])
def test_edit_distance_of_any_length(spark, long):
    rng = random.Random(long)
    make = lambda n, k: [rng.choice([None, ""] + [f"b{i}" for i in range(k)]) for _ in range(n)]
    rows = [(i, make(rng.randrange(30), rng.choice([1, 5, 50])), make(rng.randrange(30), 5)) for i in range(60)] + [(99, None, ["x"]), (98, None, None), (97, [], [None])]
    got = {r.i: r.distance for r in similarity.edit_distance(spark.createDataFrame(rows, "i int, a array<string>, b array<string>"), "a", "b", long=long).collect()}
    assert got == {i: plain_distance(a or [], b or []) for i, a, b in rows}


def test_more_distinct_items_than_characters(spark):
    rows = spark.sql("SELECT transform(sequence(1, 70000), x -> cast(x AS string)) AS a, transform(sequence(3, 70001), x -> cast(if(x % 7000 = 0, -x, x) AS string)) AS b UNION ALL SELECT array('q'), transform(sequence(1, 1000000), x -> cast(x AS string))")
    assert sorted(r.distance for r in similarity.edit_distance(rows, "a", "b").select("distance").collect()) == [13, 1_000_000]


def nested(rng, low, high, depth, out):
    """Spans inside low..high that nest or lie apart; ends may touch, and whole spans repeat."""
    at = low
    while at <= high and len(out) < 60:
        end = rng.randint(at, high)
        if rng.random() < 0.7:
            for _ in range(rng.choice([1, 1, 2])):
                out.append((at, end))
            if depth < 5:
                nested(rng, at, end, depth + 1, out)
        at = end + rng.choice([1, 1, 4])


def test_innermost_spans(spark):
    rng = random.Random(5)
    spans, events, want = [], [], []
    for run in range(30):
        own = []
        nested(rng, 0, 60 if run else 10**12, 0, own)
        rng.shuffle(own)
        own = [(run, lo, hi, f"B{i:02}") for i, (lo, hi) in enumerate(own)]
        spans += own
        places = [rng.randint(-3, 70) for _ in range(40)] + [x for _, lo, hi, _ in own for x in (lo, hi, hi + 1)]
        for i, at in enumerate(places):
            events.append((run, i, at, "v"))
            inside = [(lo, -hi, b) for _, lo, hi, b in own if lo <= at <= hi]
            if inside:
                want.append((run, i, at, "v", max(inside)[2]))
    spans.append((99, 5, 4, "empty"))
    df = spark.createDataFrame(events, "run int, step int, line long, block string")
    got = sequence.innermost(df, spark.createDataFrame(spans, "run int, low long, high long, block string"), ["run"], "line", "low", "high", "block")
    assert got.columns == ["run", "step", "line", "block", "innermost"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_literals_as_values(spark):
    texts = ["[1, 2]", "[1,2 ]", "(1, 2)", "{'a': [True, None]}", "{2, 1}", "inf", "not a literal", "'[1, 2]'", "[1.0, 2]", None]
    rows = programs.input_values(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, literal string"))
    found = {r.i: r for r in rows.select("i", programs.value_text(F.col("value")).alias("text"), programs.value_at(F.col("value"), "$[0]", "int").alias("first"), programs.value_at(F.col("value"), "$.items[1]", "int").alias("second"), programs.value_at(F.col("value"), "$", "string").alias("whole")).collect()}
    assert found[0].text == found[1].text == found[8].text == "[1,2]"  # 1 equals 1.0, by value
    assert len({r.text for r in found.values()}) == len(texts) - 2
    assert found[0].first == 1 and found[2].first is None and found[2].second == 2 and found[4].second == 2
    assert found[6].whole == "not a literal" and found[9].text is None


def test_cut_output_is_no_success(monkeypatch):
    from traceloom.functions import sandbox

    monkeypatch.setattr(sandbox, "OUTPUT_BYTES", 100)
    status, output, error = sandbox.run_script("for i in range(99):\n    print(i)\n")
    assert status == "cut" and len(output) == 100 and error.startswith("output cut")
    assert sandbox.run_script("print('x' * 200)\nraise ValueError")[0] == "failed"
    assert sandbox.run_script("print(1)")[0] == "success"
