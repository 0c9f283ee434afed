import math

import pytest

from traceloom.functions import programs, sandbox
from traceloom.functions.flow import Flow
from traceloom.operators import execute
from traceloom.plans import program_queries as Q

GOLDEN = "def fun1(n):\n    result = 0\n    for i in range(n):\n        if i % 2 == 0:\n            result += i\n        else:\n            result -= 1\n    return result\n\nx = fun1(2)\n"


def test_golden_flow():
    flow = Flow(GOLDEN)
    assert [(b.name, b.kind) for b in flow.blocks] == [("B0", "entry"), ("B1", "normal"), ("B2", "loop_head"), ("B3", "loop_body"), ("B4", "condition"), ("B5", "then"), ("B6", "normal"), ("B7", "else"), ("B8", "normal"), ("B9", "return")]
    assert flow.owners() == {1: 0, 2: 1, 3: 2, 4: 4, 5: 5, 6: 3, 7: 7, 8: 9}
    edges = {(b.name, f"B{n}") for b in flow.blocks for n in b.after}
    assert edges == {("B0", "B1"), ("B1", "B2"), ("B2", "B3"), ("B3", "B4"), ("B4", "B5"), ("B5", "B6"), ("B4", "B7"), ("B7", "B8"), ("B8", "B2"), ("B2", "B9")}


def test_flow_details():
    assert Flow("def f(:").blocks == [] and Flow("x = 1").blocks == []
    no_else = Flow("def f(a):\n    if a:\n        b = 1\n    return a")
    assert {(b.name, f"B{n}") for b in no_else.blocks for n in b.after} == {("B0", "B1"), ("B1", "B2"), ("B2", "B3"), ("B3", "B4")}
    inner = Flow("def f(a):\n    for x in a:\n        while x:\n            x -= 1")
    assert {line: inner.blocks[n].kind for line, n in inner.owners().items()} == {1: "entry", 2: "loop_head", 3: "loop_body", 4: "loop_body"}
    tried = Flow("class C:\n    def m(self):\n        try:\n            a = 1\n        except E:\n            b = 2\n        c = 3")
    assert [b.kind for b in tried.blocks] == ["entry", "try", "normal"] and 6 not in tried.owners()
    after = Flow("def f():\n    return 1\n    x = 2\n    def g():\n        pass")
    assert [b.kind for b in after.blocks] == ["entry", "return", "normal"] and list(after.blocks[1].after) == [2]


def test_queries_over_toys(spark):
    lines = {(r.task_id, r.line_no): r.block_id for r in Q.cfg_lines(spark, "").collect()}
    assert {n: lines["task_1", n] for n in range(1, 9)} == {1: "B0", 2: "B1", 3: "B2", 4: "B4", 5: "B5", 6: "B3", 7: "B7", 8: "B9"}
    assert {(r.src, r.dst) for r in Q.cfg_edges(spark, "").where("task_id = 'task_10'").collect()} == {("B0", "B1"), ("B1", "B2"), ("B2", "B3"), ("B3", "B1"), ("B1", "B4")}
    assert "[B2] loop_head    line 3-3:      for i in range(n):" in {r.task_id: r.cfg for r in Q.cfg_prompt_text(spark, "").collect()}["task_1"]
    assert {r.task_id: r.name for r in Q.callable_choice(spark, "").collect()} == {f"task_{i}": "fun1" for i in (1, 2, 10)}
    assert {r.task_id: r.syntax_ok for r in Q.syntax_gate(spark, "").collect()} == {"task_1": False, "task_2": True, "task_10": True}


def test_runs_and_traces(spark):
    runs = {r.task_id: (r.status, r.output) for r in Q.sandbox_exec(spark, "").collect()}
    assert runs == {"task_1": ("success", "-1\n1\n0\n"), "task_2": ("success", "[2, 4, 2]\n['aa']\n"), "task_10": ("timeout", "")}
    found = {(r.task_id, r["var"]): r["values"] for r in Q.program_variable_changes(spark, "").collect()}
    assert found["task_1", "n"] == ["2", "3", "0"] and found["task_1", "result"] == ["0", "-1", "0", "-1", "1", "0"]
    trace = {r.task_id: r for r in Q.program_block_trace(spark, "").collect()}
    assert trace["task_1"].block_sequence[:10] == ["B0", "B1", "B2", "B4", "B5", "B2", "B4", "B7", "B2", "B9"]
    assert trace["task_1"]["values"][:3] == ["None", "0", "-1"]
    assert trace["task_10"].block_sequence[-1] == "TRUNCATED" and len(trace["task_10"].block_sequence) == 501


def test_gate_and_repair(spark):
    got = {(r.task_id, r.kind): (r.ok, r.reason.split(":")[0], r.diff_indices) for r in Q.candidate_gate(spark, "").collect()}
    assert got["task_1", "non_equivalent"] == (True, "", [0, 1]) and got["task_1", "equivalent"] == (False, "no output differs", [])
    assert got["task_1", "rejected"][:2] == (False, "syntax")
    fixed = {r.task_id: r for r in Q.repair_loop(spark, "").collect()}
    assert [a.ok for a in fixed["task_1"].attempts] == [False, False, True] and fixed["task_2"].status == "fixed"
    said = {r.task_id: (r.status, r.result) for r in Q.replay_prediction(spark, "").collect()}
    assert said == {"task_1": ("ok", "-1\n1\n0"), "task_2": ("ok", "no tag"), "task_10": ("empty", "ERROR: empty")}


def test_judge_order():
    assert execute.judge("x = 1", ["1"], ["[1]"])[1] == "no function to call"
    assert execute.judge("def f(a):\n    while True: pass", ["1"], ["[1]"], timeout=1)[1] == "timeout"
    assert execute.judge("def f(a):\n    raise KeyError(a)", ["1"], ["[1]"])[1].startswith("failed: KeyError")
    assert execute.judge("def f(a):\n    print(a)\n    return a", ["1"], ["[1]"])[1] == "2 outputs for 1"
    assert execute.judge("def f(a):\n    return 2", ["1"], ["[1]"]) == (True, "", [0])


def test_sandbox_keeps_secrets_and_bounds_output(monkeypatch):
    monkeypatch.setenv("MY_KEY", "hidden")
    status, out, _ = sandbox.run_script("import os\nprint(os.environ.get('MY_KEY'))\nprint('x' * 3000000)")
    assert status == "cut" and out.startswith("None\n") and len(out) <= sandbox.OUTPUT_BYTES
    assert sandbox.run_script(None)[0] == "missing"
    status, events = sandbox.trace_script("a = 1\nb = a\nraise ValueError", timeout=10)
    assert status == "failed" and [e[4] for e in events if e[3] == "line"] == [1, 2, 3]


def test_retries():
    waits, said = [], iter([None, "", "yes"])
    assert execute.with_retries(lambda: next(said), 5, waits.append) == "yes" and waits == [1.0, 2.0]
    assert execute.with_retries(lambda: 1 / 0, 2, waits.append) is None


@pytest.mark.parametrize("text,value", [("[1, -2.5, (3,), {'a': {1}}]", [1, -2.5, (3,), {"a": {1}}]), ("inf", math.inf), ("-inf", -math.inf), ("None", None)])
def test_literals(text, value):
    assert programs.literal_value(text) == value


@pytest.mark.parametrize("text", ["f()", "1+2j", "__import__('os')", "x", "[i for i in y]", "{**a}", "", "(" * 500])
def test_not_literals(text):
    with pytest.raises(ValueError):
        programs.literal_value(text)


def test_inputs_of_tests():
    assert programs.list_after_inputs("inputs = [[1, ']'], {'a': (2,)}] # x") == "[[1, ']'], {'a': (2,)}]"
    assert programs.list_after_inputs("inputs = [1, (2]") is None and programs.list_after_inputs("no") is None
    assert programs.test_inputs("inputs = [[1], [inf]]\nresults = [2]") == ["[1]", "[inf]"]
    assert programs.test_inputs("inputs = [f(x)]\nresults = []") == []
    assert programs.with_inputs("a = 1\ninputs = [\n 1,\n]\nb = 2", ["[2],"]) == "a = 1\ninputs = [\n    [2],\n]\nb = 2"
    assert programs.with_inputs("a = 1", []) is None


def test_functions_and_choice():
    assert programs.functions("def f(a, b=1, *c, d): pass\nasync def g(): pass\nx = 1") == [(0, "f", 1, 2, True)]
    two = "def f(a): pass\ndef g(a, b): pass\ndef h(a): pass"
    assert programs.called_function(two, ["[1]"]) == "h" and programs.called_function(two, ["[1, 2]"]) == "g" and programs.called_function(two, ["[1,2,3]"]) == "h"
    assert programs.called_function(two, [], "f") == "f" and programs.called_function("", [], None, "d") == "d"
    assert programs.shallow([1, [2, [3, [4]]], {"a": 1}]) == "[1, [2, <list of 2>], {'a': 1}]"
