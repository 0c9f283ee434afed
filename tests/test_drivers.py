"""The stages from files to reports, end to end over small trees of files."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from traceloom import cli, drivers
from traceloom.operators import execute, rollup
from traceloom.plans import toys


def write(root, files):
    for name, content in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    return f"file://{root}"


def test_evaluate_traces(spark, tmp_path, capsys):
    truth = write(tmp_path / "t", {"original/correct/task_1.txt": "'a': [1, 2]\n'result': [3]\n", "original/correct/task_2.txt": "'a': [1]\n'result': [2]\n", "original/error/task_3.txt": "'a': [1]\n"})
    pred = write(tmp_path / "p", {"original/correct/task_1.txt": "'a': [1, 2]\n'result': [3]\n", "original/correct/task_2.txt": "'a': [1]\n'result': [9]\n", "original/error/task_3.txt": "'a': [1]\n"})
    labels = ["original/correct", "original/error", "equivalent/correct"]
    got = {r.label: r for r in drivers.evaluate_traces(*(drivers.labelled_lines(spark, d, labels) for d in (truth, pred))).collect()}
    assert (got["original/correct"].valid_files, got["original/correct"].all_matches, got["original/correct"].result_matches, got["original/correct"].vars_matched, got["original/correct"].vars_compared) == (2, 1, 1, 3, 4)
    assert got["original/error"].skipped_files == 1 and got["total"].valid_files == 2
    cli.main(["evaluate-traces", "--truth", truth, "--predicted", pred])
    assert "original/correct" in capsys.readouterr().out


def test_evaluate_blocks_gives_the_golden_classes(spark, tmp_path, capsys):
    paths = {1: ("A,B", "A,B,A,B"), 2: ("A,B", "B,A"), 3: ("A,B", "A,C"), 4: ("A,B,C", "A,B"), 5: ("A,B", "A,A"), 6: ("A,B", "A,B"), 7: ("A,B", "A,B")}
    line = lambda path, v: "'block_sequence': [" + ", ".join(f"'{b}'" for b in path.split(",")) + f"]\n'total': [{v}]\n"
    truth = write(tmp_path / "t", {f"x/task_{i}.txt": line(t, "1, 2") for i, (t, _) in paths.items()})
    pred = write(tmp_path / "p", {f"x/task_{i}.txt": line(p, "1, 2" if i != 7 else "1, 5") for i, (_, p) in paths.items()})
    sides = [drivers.labelled_lines(spark, d, ["x"]) for d in (truth, pred)]
    scores, errors = drivers.evaluate_blocks(*sides)
    assert {r.error_type: (r.n, r.place) for r in errors.collect()}.keys() == {"WRONG_ITER_COUNT", "WRONG_ORDER", "WRONG_BRANCH", "EARLY_TERMINATION", "MIXED_ERROR", "PERFECT", "PATH_OK_VALUE_ERR"}
    total = {r.label: r for r in scores.collect()}["total"]
    assert (total.files, total.path_exact, total.values_exact, total.final_correct, total.reasoning_illusions) == (7, 2, 6, 6, 5)
    cli.main(["evaluate-blocks", "--truth", truth, "--predicted", pred, "--label", "x"])
    assert "WRONG_BRANCH" in capsys.readouterr().out


def test_first_variable_and_ranks(spark):
    lines = spark.createDataFrame([(1, 1, "'block_sequence': [1]"), (1, 2, "'z': [1]"), (1, 3, "'a': [1]"), (2, 1, "no name"), (2, 2, '"block_sequence" : [2]')], "task int, line_no int, value string")
    assert {r.task: r.variable for r in rollup.output_variables(lines, ["task"]).collect()} == {1: "z", 2: "result"}
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "c", 3), ("g", "c", 4)], "g string, x string, at int")
    assert [(r.x, r.n, r.place) for r in rollup.by_count(rows, ["g"], "x", "at").orderBy("place").collect()] == [("c", 2, 1), ("b", 1, 2), ("a", 1, 3)]


def test_validation_report(spark, tmp_path, capsys):
    orig = write(tmp_path / "o", {f"task_{i}.txt": "1\n2\n3\n4\n" for i in (1, 2, 3)})
    same = write(tmp_path / "e", {"task_1.txt": "1\n2\n3\n4\n", "task_2.txt": "1\n9\n3\n"})
    diff = write(tmp_path / "n", {"task_1.txt": "1\n2\n3\n4\n", "task_2.txt": "0\n2\n3\n4\n"})
    inputs = write(tmp_path / "i", {f"task_{i}.txt": "[1]\n\n[2]\n[3]\n[4]\n" for i in (1, 2, 3)})
    cli.main(["validate", "--original", orig, "--equivalent", same, "--different", diff, "--inputs", inputs, "--report", f"file://{tmp_path}/report", "--include-missing"])
    assert "same_result" in capsys.readouterr().out
    report = {r.kind: r for r in spark.read.json(f"file://{tmp_path}/report").collect()}
    e, n = report["equivalent"], report["non_equivalent"]
    assert (e.summary.passed, e.summary.failed, e.summary.missing) == (1, 2, 1) and (n.summary.passed, n.summary.failed, n.summary.missing) == (1, 2, 1)
    assert [(x.task_id, x.reason, [(c.input, c.original, c.mutated) for c in x.examples or []]) for x in e.tasks] == [("task_2", "different_result", [("[2]", "2", "9"), ("[4]", "4", None)]), ("task_3", "missing_result", [])]
    assert [(x.task_id, x.reason, len(x.examples or [])) for x in n.tasks] == [("task_1", "same_result", 3), ("task_3", "missing_result", 0)]


@pytest.fixture
def tasks(spark):
    rows = [(t[0], t[1], "fun1", ["[2]", "[3]"] if t[0] == "task_1" else ["[[1, 2]]"]) for t in toys.TASKS[:2]]
    return spark.createDataFrame(rows, "task_id string, code string, preferred string, literals array<string>")


def test_retry_replaces_what_failed(spark, tmp_path, tasks):
    good = {t[0]: t[4] for t in toys.TASKS}
    mutants = spark.createDataFrame([("equivalent", t[0], t[5]) for t in toys.TASKS[:2]] + [("non_equivalent", t[0], t[5]) for t in toys.TASKS[:2]], "kind string, task_id string, mutant string")
    without = drivers.run_validation(tasks, mutants, None, f"file://{tmp_path}/a", timeout=10)
    assert {(r.kind, r.passed, r.failed) for r in without.summary.collect()} == {("equivalent", 0, 2), ("non_equivalent", 2, 0)}
    asked = {r.task_id: r.prompt for r in drivers.retry_prompts(without, mutants.where("kind = 'equivalent'").join(tasks.select("task_id", "code"), "task_id")).collect()}
    assert "input [2]: -2 instead of -1" in asked["task_1"] and set(asked) == {"task_1", "task_2"}
    answers = {"task_1": [f"<result>\n{good['task_1']}\n</result>"], "task_2": ["<result>\ndef fun1(:\n</result>"]}
    after = drivers.run_validation(tasks, mutants, lambda: execute.Replay(answers), f"file://{tmp_path}/b", timeout=10)
    assert {(r.kind, r.task_id): r.reason for r in after.verdicts.collect()} == {("equivalent", "task_1"): "passed", ("equivalent", "task_2"): "different_result", ("non_equivalent", "task_1"): "passed", ("non_equivalent", "task_2"): "passed"}


def test_mutate(tasks):
    answers = {"task_1": ["<result>\ndef fun1(n):\n    return 1\n</result>"], "task_2": ["no program ("]}
    got = {r.task_id: (r.status, r.mutant) for r in drivers.mutate(tasks, "equivalent", lambda: execute.Replay(answers), tries=1).collect()}
    assert got == {"task_1": ("ok", "def fun1(n):\n    return 1"), "task_2": ("no_syntax", None)}
    with pytest.raises(ValueError):
        drivers.mutate(tasks, "other", lambda: None)


def test_repair_refresh_report_and_invalidation(spark, tasks):
    rows = tasks.where("task_id = 'task_1'").withColumn("mutant", F.lit(toys.TASKS[0][4])).withColumn("original", F.array(F.lit("-1"), F.lit("1")))
    problems = spark.createDataFrame([("task_1", "fully_same"), ("task_2", "empty_compare"), ("task_10", "failed_or_timeout")], "task_id string, problem string")
    assert [r.task_id for r in drivers.selected_problems(problems).collect()] == ["task_1", "task_2", "task_10"]
    assert [r.task_id for r in drivers.selected_problems(problems, " 10, task_2", 1).collect()] == ["task_2"]
    refreshed = drivers.repair(rows, problems, None, timeout=10).collect()
    assert [(r.task_id, r.status, r.diff_count, r.old_hash == r.new_hash) for r in refreshed] == [("task_1", "failed", 0, True)]
    answers = {"task_1": [toys.TASKS[0][4], toys.TASKS[0][5]]}
    done = drivers.repair(rows, problems, lambda: execute.Replay(answers), timeout=10).collect()
    fixed = spark.createDataFrame(done, "task_id string, status string, attempts array<struct<attempt:int,ok:boolean,reason:string,diff_indices:array<int>>>, diff_count int, diff_indices array<int>, old_hash string, new_hash string, new string")
    (r,) = fixed.collect()
    assert (r.status, len(r.attempts), r.diff_indices, r.old_hash != r.new_hash, r.new) == ("fixed", 2, [0, 1], True, toys.TASKS[0][5])
    (report,) = drivers.repair_report(problems, fixed).collect()
    assert report.selected_task_count == 1 and report.outcomes.fixed == 1 and report.discovered.fully_same == 1
    dependent = spark.createDataFrame([("task_1", "old"), ("task_2", "kept")], "task_id string, x string")
    assert [x.task_id for x in drivers.invalidated(fixed, dependent).collect()] == ["task_2"]


def test_compare_and_clean(spark, tmp_path, capsys):
    orig = write(tmp_path / "o", {"task_1.txt": "1\n2\n", "task_2.txt": "1\n"})
    mut = write(tmp_path / "m", {"task_1.txt": "1\n3\n", "task_3.txt": "1\n"})
    cli.main(["compare", "--original", orig, "--mutant", mut, "--out", f"file://{tmp_path}/c"])
    out = capsys.readouterr().out
    assert "no_mutant_result" in out and "no_original_result" in out
    assert sorted((r.line_no, r.is_valid) for r in spark.read.parquet(f"file://{tmp_path}/c").collect()) == [(1, False), (2, True)]
    texts = write(tmp_path / "x", {"a/task_1.txt": "1 2  3\n", "a/task_2.txt": "1\n2\n", "a/task_3.txt": "ERROR: empty"})
    cli.main(["clean", "--texts", texts, "--label", "a", "--out", f"file://{tmp_path}/k"])
    assert {r.task_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/k").collect()} == {"task_1": "1\n2\n3\n", "task_2": "1\n2\n"}


def test_a_service_answers_over_http(spark, tmp_path, monkeypatch):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body["model"], self.headers.get("Authorization")))
            if len(seen) == 1:
                self.send_error(500)
                return
            reply = json.dumps({"choices": [{"message": {"content": f"<result>{len(body['messages'][0]['content']) > 20}</result>"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv("A_KEY", "k1")
        service = execute.Service(f"http://127.0.0.1:{server.server_port}", "m", "${A_KEY}", timeout=5)
        assert execute.with_retries(lambda: service.answer("t", "a question of some length"), 3, lambda _: None) == "<result>True</result>"
        assert seen == [("m", "Bearer k1")] * 2
        scripts = write(tmp_path / "s", {"task_1/p.py": toys.ARITHMETIC, "task_2/p.py": toys.MUTATION})
        for _ in range(2):  # a second run asks nothing
            cli.main(["predict", "--scripts", scripts, "--out", f"file://{tmp_path}/out", "--kind", "blocks", "--service", f"http://127.0.0.1:{server.server_port}", "--model", "m", "--workers", "2", "--tries", "2"])
        assert {r.result for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"True"} and len(seen) == 4
    finally:
        server.shutdown()
