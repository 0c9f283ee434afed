"""One command over all modes and statuses against a run for each folder; swapped inputs, first cases, validation that runs."""

import json

import pytest

from traceloom import cli, modes
from traceloom.plans import toys

PROGRAM = "inputs = [[1], [2]]\n\n\ndef fun1(n):\n    total = {k}\n    for i in range(n):\n        total += i\n    return total\n\n\nfor one in inputs:\n    print(fun1(*one))\n"


@pytest.fixture
def tree(tmp_path):
    for k, mode in enumerate(modes.MODES):
        for status in modes.STATUSES:
            if (mode, status) == ("equivalent", "error"):
                continue  # a route that isn't there
            for i in range(1, 3 + k):
                at = tmp_path / f"scripts/{mode}/{status}/task_{i}.py"
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(PROGRAM.format(k=k + i) if i != 3 else "raise ValueError\n")
    return tmp_path


def rows(spark, path, *columns):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in spark.read.parquet(str(path)).collect())


@pytest.mark.parametrize("command,columns", [("execute", ("task_id", "status", "output")), ("trace", ("task_id", "var", "values")), ("writes", ("task_id", "var", "values")), ("blocks", ("task_id", "block_id", "source_snippet"))])
def test_one_run_covers_the_routes(spark, tree, command, columns):
    cli.main([command, "--scripts", f"{tree}/scripts", "--mode", "all", "--status", "all", "--out", f"{tree}/all"])
    got = rows(spark, tree / "all", "label", *columns)
    want = []
    for label in ("original/correct", "non_equivalent/error"):
        cli.main([command, "--scripts", f"{tree}/scripts/{label}", "--out", f"{tree}/one/{label}"])
        want += [(label, *r) for r in rows(spark, tree / "one" / label, *columns)]
    assert sorted(want) == [r for r in got if r[0] in ("original/correct", "non_equivalent/error")]
    assert {r[0] for r in got} == {f"{m}/{s}" for m in modes.MODES for s in modes.STATUSES} - {"equivalent/error"}


def test_chosen_routes(spark, tree, capsys):
    assert modes.routes(None, None) is None and modes.routes("all", None) == list(modes.MODES) and modes.routes("original", "error") == ["original/error"]
    cli.main(["execute", "--scripts", f"{tree}/scripts", "--mode", "all", "--status", "error", "--limit", "1", "--out", f"{tree}/some", "--files", f"{tree}/files"])
    assert rows(spark, tree / "some", "label", "task_id") == [("non_equivalent/error", "task_1"), ("original/error", "task_1")]
    assert (tree / "files/original/error/task_1.txt").read_text() == "1\n2\n"
    with pytest.raises(SystemExit, match="none of these"):
        cli.main(["blocks", "--scripts", f"{tree}/scripts", "--mode", "equivalent", "--status", "error", "--out", f"{tree}/none"])
    (tree / "answers/original/correct").mkdir(parents=True)
    (tree / "answers/original/correct/task_2.txt").write_text("<result>\n7\n</result>")
    cli.main(["predict", "--scripts", f"{tree}/scripts", "--mode", "original", "--status", "all", "--answers", f"{tree}/answers", "--out", f"{tree}/predicted"])
    assert [r for r in rows(spark, tree / "predicted", "label", "task_id", "result") if r[2] == "7"] == [("original/correct", "task_2", "7")]


def test_swapped_inputs(spark, tmp_path):
    for i in (1, 2, 3):
        at = tmp_path / f"scripts/original/task_{i}/program.py"
        at.parent.mkdir(parents=True)
        at.write_text(PROGRAM.format(k=0) if i < 3 else "print(1)\n")
        for status in ("correct", "error"):
            at = tmp_path / f"inputs/original/{status}/task_{i}.txt"
            at.parent.mkdir(parents=True, exist_ok=True)
            if (i, status) != (2, "error"):
                at.write_text("[4]\n" if status == "correct" else "[5]\n[6]\n")
    cli.main(["swap", "--scripts", f"{tmp_path}/scripts", "--inputs", f"{tmp_path}/inputs", "--out", f"{tmp_path}/out", "--files", f"{tmp_path}/files"])
    assert rows(spark, tmp_path / "out", "label", "task_id", "outcome") == [
        ("original/correct", "task_1", "written"), ("original/correct", "task_2", "written"), ("original/correct", "task_3", "no_inputs_in_script"),
        ("original/error", "task_1", "written"), ("original/error", "task_2", "missing_inputs"), ("original/error", "task_3", "no_inputs_in_script"),
    ]
    cli.main(["execute", "--scripts", f"{tmp_path}/files", "--mode", "original", "--status", "all", "--out", f"{tmp_path}/runs"])
    assert rows(spark, tmp_path / "runs", "label", "task_id", "output") == [("original/correct", "task_1", "6\n"), ("original/correct", "task_2", "6\n"), ("original/error", "task_1", "10\n15\n")]


def test_first_cases_as_files(spark, tmp_path):
    for side, text in (("truth", "1\n2\n3\n"), ("predicted", "1\n9\n3\n"), ("inputs", "[a]\n[b]\n[c]\n")):
        at = tmp_path / f"{side}/original/task_1.txt"
        at.parent.mkdir(parents=True)
        at.write_text(text)
    for mode in modes.MODES[1:]:
        for side in ("truth", "predicted", "inputs"):
            (tmp_path / side / mode).mkdir(parents=True)
    cli.main(["evaluate", "--truth", f"{tmp_path}/truth", "--predicted", f"{tmp_path}/predicted", "--inputs", f"{tmp_path}/inputs", "--mode", "original", "--first-cases", f"{tmp_path}/cases"])
    assert (tmp_path / "cases/task_1/original_correct_inputs.txt").read_text() == "[a]\n"
    assert (tmp_path / "cases/task_1/original_error_inputs.txt").read_text() == "[b]\n"


def test_validation_that_runs(spark, tmp_path, capsys):
    (tmp_path / "tasks.json").write_text(json.dumps([{"task_id": int(t[0][5:]), "code": t[1], "test": t[2], "test_list": t[3]} for t in toys.TASKS[:2]]))
    for t in toys.TASKS[:2]:
        for kind, code in (("equivalent", t[4]), ("non_equivalent", t[5])):
            at = tmp_path / f"mutants/{kind}/{t[0]}.py"
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(code)
    common = ["validate", "--run-exec", "--tasks", f"{tmp_path}/tasks.json", "--mutants", f"{tmp_path}/mutants", "--out", f"{tmp_path}/out"]
    cli.main([*common, "--report", f"{tmp_path}/report"])
    report = {r.kind: r.summary for r in spark.read.json(f"{tmp_path}/report").collect()}
    assert (report["equivalent"].passed, report["equivalent"].failed, report["non_equivalent"].passed) == (2, 0, 2)
    before = [p.stat().st_mtime_ns for p in sorted((tmp_path / "out/original").iterdir())]
    (tmp_path / "mutants/equivalent/task_1.py").write_text("def fun1(n):\n    raise ValueError\n")
    cli.main([*common, "--skip-original"])
    assert before == [p.stat().st_mtime_ns for p in sorted((tmp_path / "out/original").iterdir())]
    with pytest.raises(RuntimeError, match="equivalent failed"):
        cli.main([*common, "--stop-on-error"])
    with pytest.raises(SystemExit):
        cli.main([*common, "--retry"])


def test_lineage_commands(spark, tmp_path, capsys):
    for stage, n in (("code", 1), ("mutant", 2), ("graph", 3)):
        spark.sql(f"SELECT 'task_' || id AS task_id, {n} * id AS v FROM range(3)").write.parquet(f"{tmp_path}/{stage}")
    tables = ["--tables", *[f"{s}={tmp_path}/{s}" for s in ("code", "mutant", "graph")], "--records", f"{tmp_path}/records"]
    cli.main(["record", *tables])
    spark.sql("SELECT 'task_' || id AS task_id, if(id = 1, 7, id) AS v FROM range(3)").write.mode("overwrite").parquet(f"{tmp_path}/code")
    cli.main(["stale", *tables, "--drop"])
    assert "mutant" in capsys.readouterr().out
    assert rows(spark, tmp_path / "mutant", "task_id") == [("task_0",), ("task_2",)] == rows(spark, tmp_path / "graph", "task_id")


def test_loaded_tasks_as_folders(spark, tmp_path):
    test = "import x\ninputs = [[2], [3], ['a', (1, 2)]]\nresults = [1, 2]\nfor i, (inp, exp) in enumerate(zip(inputs, results)):\n    assertion(fun1(*inp), exp, 0) # no\n"
    (tmp_path / "tasks.json").write_text(json.dumps([{"task_id": 5, "code": "def fun1(n):\n    return n", "test": test, "test_list": []}, {"task_id": 6, "code": "x = 1", "test": "nothing", "test_list": []}]))
    (tmp_path / "footer.py").write_text("print(result)\n")
    cli.main(["load", "--tasks", f"{tmp_path}/tasks.json", "--out", f"{tmp_path}/inputs", "--sample-size", "2", "--files", f"{tmp_path}/tree", "--footer", f"{tmp_path}/footer.py"])
    at = tmp_path / "tree/task_5"
    assert sorted(p.name for p in at.iterdir()) == ["code.py", "code_inputs.txt", "combined.py", "results.txt", "sample_code_inputs.txt", "task_5.json"]
    assert (at / "code.py").read_text() == "def fun1(n):\n    return n\n" and (at / "results.txt").read_text() == "[1, 2]"
    assert (at / "code_inputs.txt").read_text() == "[2]\n[3]\n['a', (1, 2)]\n" and len((at / "sample_code_inputs.txt").read_text().splitlines()) == 2
    combined = (at / "combined.py").read_text()
    assert combined.startswith("def fun1(n):\n    return n\ninputs = [[2], [3], ['a', (1, 2)]]\nresult = []\nfor inp in inputs:\n    result.append(fun1(*inp)") and combined.endswith("print(result)\n\n")
    assert json.loads((at / "task_5.json").read_text())["task_num"] == 5
    assert sorted(p.name for p in (tmp_path / "tree/task_6").iterdir()) == ["code.py", "combined.py", "task_6.json"]
