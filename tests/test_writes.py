"""Instrumented programs against a trace of the same programs, and spans against their source."""

import random

import pytest

from traceloom.functions import sandbox, writes
from traceloom.operators import execute, sequence
from traceloom.sources import files

PROGRAM = '''"""doc"""
from __future__ import annotations
import contextlib
total: int = 0
unset: int
a = b = [0]
(c, *d), é = (1, 2, 3), "ß"
class Box:
    size = 3
    def __init__(self, n):
        self.n = n
        self.__own = n
box = Box(2)
box.n += 5
def f(xs, k=1):
    global total
    for i, (p, q) in enumerate(xs):
        xs[i] = p + q
        total += xs[i]
        if (half := total // 2) > 1:
            d[0] -= half
    else:
        done = True
    while k > 0: k -= 1; xs.append(k)
    return [y for y in xs]
a[0:1] = f([(1, 2), (3, 4)])
a[len(a) - 1] += 7
with contextlib.nullcontext((4, 5)) as (g, h), contextlib.nullcontext(6) as w:
    g = g * w
try:
    raise ValueError("no")
except ValueError as e:
    message = str(e)
match {"x": [1, 2, 3], "y": 9}:
    case {"x": [first, *others], **left} if first == 1:
        seen = first
for d[0] in (8, 9): pass
Box(1).n = 3
print(total, message)
'''


def reported(code):
    script, spans = writes.instrumented(code)
    status, count, events = sandbox.writing_script(script, writes.HOOK)
    assert count == len(events)
    named = {iid: name for iid, name, *_ in spans}
    out = {}
    for _, iid, value, _ in events:
        out.setdefault(named[iid], []).append(value)
    return status, out, spans


def test_all_kinds_of_writes():
    status, out, spans = reported(PROGRAM)
    assert status == "success"
    assert out["total"] == ["0", "3", "10"] and out["half"] == ["1", "5"] and "unset" not in out
    assert out["a"] == ["[0]", "[3, 7, 0]", "[3, 7, 7]"] and out["b"] == ["[0]"]
    assert out["d"] == ["[2, 3]", "[-3, 3]", "[8, 3]", "[9, 3]"]
    assert (out["c"], out["é"], out["size"], out["done"]) == (["1"], ["'ß'"], ["3"], ["True"])
    assert out["i"] == ["0", "1"] and out["p"] == ["1", "3"] and out["q"] == ["2", "4"]
    assert out["xs"] == ["[3, (3, 4)]", "[3, 7]"] and out["k"] == ["0"]
    assert (out["g"], out["h"], out["w"]) == (["4", "24"], ["5"], ["6"])
    assert out["message"] == ["'no'"] and out["e"] == ["ValueError('no')"]
    assert (out["first"], out["others"], out["left"], out["seen"]) == (["1"], ["[2, 3]"], ["{'y': 9}"], ["1"])
    assert len(out["box"]) == 2 and len(out["self"]) == 4 and "y" not in out
    lines = PROGRAM.splitlines()
    for _, name, line, start, end_line, end in spans:
        if line == end_line:  # the place is the target's, in characters
            assert name in lines[line - 1][start:end]


def test_output_and_errors_stay_as_they_were():
    for code in (PROGRAM, "x = 1\nprint(x)\ny = x / 0\nz = 2\n", "def f():\n    return f()\nr = f()\n"):
        script, _ = writes.instrumented(code)
        own = sandbox.run_script(code)
        hooked = sandbox.run_script(f"import builtins\nbuiltins.{writes.HOOK} = lambda iid, v: v\nexec(compile({script!r}, 'p', 'exec'))")
        assert (own[0], own[1]) == (hooked[0], hooked[1])
        if own[0] == "failed":
            assert own[2].strip().splitlines()[-1] == hooked[2].strip().splitlines()[-1]


def random_program(rng):
    names, body = "stuvw", []
    expr = lambda: f"({rng.choice(names)} {rng.choice('+-*')} {rng.randrange(5)}) % 97"

    def block(depth, indent):
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(7 if depth < 3 else 4)
            x, y = rng.sample(names, 2)
            pad = " " * indent
            if kind == 0:
                body.append(f"{pad}{x} = {expr()}")
            elif kind == 1:
                body.append(f"{pad}{x} += {expr()}")
            elif kind == 2:
                body.append(f"{pad}{x}, {y} = {expr()}, {expr()}")
            elif kind == 3:
                body.append(f"{pad}xs[{x} % 4] = {expr()}")
            elif kind == 4:
                body.append(f"{pad}if {x} % 2 == 0:")
                block(depth + 1, indent + 1)
            elif kind == 5:
                body.append(f"{pad}for i{depth} in range({rng.randrange(4)}):")
                block(depth + 1, indent + 1)
            else:
                body.append(f"{pad}for i{depth}, {x} in enumerate([{rng.randrange(9)}, {rng.randrange(9)}]):")
                block(depth + 1, indent + 1)

    block(0, 0)
    return "\n".join([*[f"{x} = {rng.randrange(20)}" for x in names], "xs = [0, 0, 0, 0]", *body, "last = 0", ""])


def test_writes_without_repeats_are_the_changes_of_a_trace(spark):
    """Variables of the module, whose every change a trace of line events shows: the same values in the same order."""
    rng = random.Random(7)
    rows = [(f"p{i}", random_program(rng)) for i in range(25)] + [("broken", "x = (")]
    tasks = spark.createDataFrame(rows, "task string, code string")
    made = execute.instrumented(tasks, ["task"]).cache()
    events = execute.write_events(execute.write_runs(made, ["task"]), execute.spans_of(made, ["task"]), ["task"])
    got = sequence.collected(sequence.changes(events, ["task", "var"], "step", "value"), ["task", "var"], "step", "value", "values")
    traced = sequence.traced(execute.trace_events(tasks, ["task"], "code").where("var IS NOT NULL"))
    want = sequence.collected(sequence.changes(traced, ["task", "var"], "step", "value"), ["task", "var"], "step", "value", "values")
    rows = lambda df: sorted((r.task, r["var"], r["values"]) for r in df.collect())
    assert rows(got) == rows(want)
    assert made.where("script IS NULL").count() == 1
    made.unpersist()


def test_stopped_and_cut_programs(spark):
    rows = [("endless", "n = 0\nwhile True:\n    n += 1\n"), ("many", "for i in range(50):\n    pass\n"), ("none", None), ("fails", "x = 1\nraise SystemExit(3)\n"), ("quiet", "pass")]
    made = execute.instrumented(spark.createDataFrame(rows, "task string, code string"), ["task"])
    runs = {r.task: (r.status, r.written, len(r.events)) for r in execute.write_runs(made, ["task"], timeout=2, most=10).collect()}
    assert runs == {"endless": ("timeout", None, 10), "many": ("success", 50, 10), "none": ("missing", None, 0), "fails": ("failed", 1, 1), "quiet": ("success", 0, 0)}


def test_span_maps_on_disk(spark, tmp_path):
    made = execute.instrumented(spark.createDataFrame([("t", "x = 1\nfor é, y in [(1, 2)]:\n    x += y\n")], "task string, code string"), ["task"])
    spans = execute.spans_of(made, ["task"])
    for r in files.span_maps(spans, ["task"], "t.py").collect():
        (tmp_path / f"{r.task}.json").write_text(r.json)
    back = files.iid_spans(spark, str(tmp_path))
    columns = ["iid", "variable", "start_line", "start_column", "end_line", "end_column"]
    assert sorted(back.select(*columns).collect()) == sorted(spans.select(*columns).collect())
    assert {r.file for r in back.collect()} == {"t.py"}
    named = files.span_names(back.select("path", "iid").limit(2), back.select("path", "iid", "variable"))
    assert all(r.variable for r in named.collect())


@pytest.mark.parametrize("code", ["", "x: int", "def f(x): return x", "import os", "class A: pass", "[x for x in y]"])
def test_programs_without_writes(code):
    assert writes.instrumented(code)[1] == []
