"""What a change makes stale, over four levels and more; tables without it; the recursive closure."""

import random

import pytest

from traceloom.operators import lineage
from traceloom.sources import folders

TASKS = ["task_1", "task_2", "task_3"]


def tables(spark, **changes):
    """Two rows of each stage for each task. changes: stage -> {task: value}."""
    out = {}
    for s in lineage.GRAPH:
        if s not in lineage.WHOLE:
            values = ", ".join(f"('{t}', {i}, '{changes.get(s, {}).get(t, f'{s} of {t}')}')" for t in TASKS for i in (1, 2))
            out[s] = spark.sql(f"SELECT * FROM VALUES {values} AS x(task_id, line_no, value)")
    return out


def records(spark, found):
    return lineage.input_hashes(found, lineage.GRAPH)


def stale_of(spark, **changes):
    before = records(spark, lineage.all_contents(tables(spark)))
    return {tuple(r) for r in lineage.stale(lineage.changed(lineage.all_contents(tables(spark, **changes)), before)).collect()}


def after(stage):
    """Plain closure: all that is built on a stage."""
    out, todo = set(), [stage]
    while todo:
        x = todo.pop()
        for s, needs in lineage.GRAPH.items():
            if x in needs and s not in out:
                out.add(s)
                todo.append(s)
    return out


@pytest.mark.parametrize("stage", ["inputs", "compare"])
def test_exactly_what_is_built_on_a_change_is_stale(spark, stage):
    want = {(None if s in lineage.WHOLE else "task_2", s) for s in after(stage)}
    assert stale_of(spark, **{stage: {"task_2": "changed"}}) == want
    assert len(want) > 1


def test_one_program_four_levels(spark):
    found = stale_of(spark, code={"task_1": "x = 1"})
    assert {"mutant", "mutant_run", "compare", "trace", "scores"} <= {s for t, s in found if t == "task_1"}
    assert {t for t, _ in found} == {"task_1", None} and ("task_1", "code") not in found
    assert stale_of(spark) == set()


def test_closure_of_random_graphs(spark):
    rng = random.Random(1)
    for n in (1, 6, 12):
        graph = {f"s{i}": [f"s{j}" for j in range(i) if rng.random() < 0.4] for i in range(n)}
        want = {(s, s) for s in graph}
        for _ in graph:
            want |= {(a, s) for a, b in want for s, needs in graph.items() if b in needs}
        assert {tuple(r) for r in lineage.downstream(spark, graph).collect()} == want
    with pytest.raises(ValueError, match="cycle"):
        lineage.downstream(spark, {"a": ["b"], "b": ["a"]})


def test_content_hashes(spark):
    rows = [("t", 1, "a"), ("t", 2, None), ("u", 1, "a")]
    make = lambda r: spark.createDataFrame(r, "task_id string, n int, v string")
    told = lambda df, s="s": {r.task_id: r.hash for r in lineage.contents(df, s).collect()}
    one = told(make(rows))
    assert told(make(rows[::-1])) == one == told(make(rows).select("v", "task_id", "n").repartition(5))
    for other in ([*rows, rows[0]], [("t", 1, "a"), ("t", 2, "null"), rows[2]], [("t", 1, "a"), ("t", 2, ""), rows[2]], [("t", 2, "a"), ("t", 1, None), rows[2]]):
        found = told(make(other))
        assert found["t"] != one["t"] and found["u"] == one["u"]
    assert told(make([])) == {}


def test_tables_are_rid_of_what_is_stale(spark, tmp_path):
    paths = {s: f"{tmp_path}/{s}" for s in lineage.GRAPH}
    at = str(tmp_path / "records")
    for s, t in tables(spark).items():
        t.write.parquet(paths[s])
    spark.createDataFrame([("all", 1)], "task_id string, n int").write.parquet(paths["report"])
    assert lineage.invalidate(spark, paths, at).count() == 0
    lineage.record(spark, paths, at)
    assert lineage.invalidate(spark, paths, at).count() == 0
    new = tables(spark, code={"task_3": "y"})["code"]
    new.write.mode("overwrite").parquet(paths["code"])
    told = {tuple(r) for r in lineage.invalidate(spark, paths, at, drop=False).collect()}
    void = {tuple(r) for r in lineage.invalidate(spark, paths, at).collect()}
    assert told == void == {(None if s in lineage.WHOLE else "task_3", s) for s in after("code")}
    for s in lineage.GRAPH:
        rows = spark.read.parquet(paths[s])
        want = 0 if s == "report" else 6 if s not in after("code") else 4
        assert rows.count() == want, s
        if want == 4:
            assert {r.task_id for r in rows.collect()} == {"task_1", "task_2"}
    # run again, all holds, recorded or not
    for s, t in tables(spark, code={"task_3": "y"}).items():
        if s in after("code"):
            t.write.mode("overwrite").parquet(paths[s])
    assert lineage.invalidate(spark, paths, at).count() == 0
    lineage.record(spark, paths, at, sorted(after("code") - lineage.WHOLE))
    assert lineage.invalidate(spark, paths, at).count() == 0
    assert not folders.exists(spark, paths["compare"] + "-kept")
