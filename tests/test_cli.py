import json

from pyspark.sql import functions as F

from traceloom import cli
from traceloom.functions import text
from traceloom.operators import programs
from traceloom.plans import toys


def test_stages_over_files(spark, tmp_path, capsys):
    (tmp_path / "tasks.json").write_text(json.dumps([{"task_id": int(t[0][5:]), "code": t[1], "test": t[2], "test_list": t[3]} for t in toys.TASKS[:2]]))
    root = f"file://{tmp_path}"
    cli.main(["load", "--tasks", f"{root}/tasks.json", "--out", f"{root}/inputs"])
    assert spark.read.parquet(f"{root}/inputs").count() == 5
    cli.main(["splice", "--tasks", f"{root}/tasks.json", "--out", f"{root}/spliced"])
    scripts = {r.task_id: r.script for r in spark.read.parquet(f"{root}/spliced").collect()}
    assert set(scripts) == {"task_1", "task_2"} and "fun1(*one)" in scripts["task_1"]
    for task, script in scripts.items():
        (tmp_path / "scripts" / task).mkdir(parents=True)
        (tmp_path / "scripts" / task / "program.py").write_text(script)
    for command in ("execute", "trace", "blocks"):
        for _ in range(2):  # a second run finds its work done
            cli.main([command, "--scripts", f"{root}/scripts", "--out", f"{root}/{command}", "--timeout", "10"])
    runs = {r.task_id: r for r in spark.read.parquet(f"{root}/execute").collect()}
    assert len(runs) == 2 and runs["task_1"].status == "success"
    for side in ("truth/original", "predicted/original"):
        (tmp_path / side).mkdir(parents=True)
        (tmp_path / side / "task_1.txt").write_text(runs["task_1"].output if side.startswith("truth") else "-1\n7\n")
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "task_1.txt").write_text("<result>\n-1\n</result>")
    cli.main(["evaluate", "--truth", f"{root}/truth", "--predicted", f"{root}/predicted", "--mode", "original", "--report", f"{root}/report"])
    (report,) = spark.read.json(f"{root}/report").collect()
    assert report.summary.same_cases == 1 and report.summary.total_cases == 3 and report.tasks[0].diff_lines == [2, 3]
    cli.main(["predict", "--scripts", f"{root}/scripts", "--answers", f"{root}/answers", "--out", f"{root}/predictions"])
    assert {r.task_id: (r.status, r.result) for r in spark.read.parquet(f"{root}/predictions").collect()} == {"task_1": ("ok", "-1"), "task_2": ("empty", "ERROR: empty")}
    cli.main(["validate", "--original", f"{root}/truth/original", "--mutant", f"{root}/predicted/original", "--include-missing"])
    assert "different_result" in capsys.readouterr().out
    cli.main(["problems", "--tasks", f"{root}/tasks.json", "--results", f"{root}/truth/original", "--compared", f"{root}/predicted/original"])
    assert "task_2" in capsys.readouterr().out


def test_small_pieces(spark):
    df = spark.createDataFrame([("task_3", ["a", "b", "c"])], "t string, x array<string>")
    row = df.select(text.up_to(F.col("t"), 2).alias("a"), text.up_to(F.lit("other"), 2).alias("b"), text.none_of(F.col("t"), ["_4", "_3"]).alias("c"), text.shown(F.col("x"), 2).alias("d"), text.block_trace_lines(F.col("x"), F.lit("r"), F.col("x")).alias("e")).first()
    assert tuple(row) == (False, True, False, "a, b, and 1 more", "'block_sequence': ['a', 'b', 'c']\n'r': [a, b, c]\n")
    tasks = spark.createDataFrame([("a", "inputs = [1]\nx"), ("b", "y")], "task string, script string")
    inputs = spark.createDataFrame([("a", 1, "[5]"), ("b", 1, "6")], "task string, line_no int, literal string")
    assert {r.task: r.script for r in programs.with_new_inputs(tasks, inputs, ["task"]).collect()} == {"a": "inputs = [\n    [5],\n]\nx", "b": None}
    stored = spark.createDataFrame([("a", "kept")], "task string, cfg string")
    code = spark.createDataFrame([("a", "def f(): pass"), ("b", "def f():\n    return 1")], "task string, code string")
    assert {r.task: r.cfg.split("\n")[0] for r in programs.stored_or_built(code, stored, ["task"]).collect()} == {"a": "kept", "b": "[B0] entry        line 1-1:  def f():"}
