import random
import re

import pytest
from pyspark.sql import functions as F

from traceloom import schemas
from traceloom.functions import programs, text
from traceloom.sources import files, sinks


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("<result></result>", ""), ("no tag ", "no tag"), (None, "ERROR: empty"), ("", "ERROR: empty"), ("a<result>\n 1\n2 </result><result>3</result>", "1\n2"), ("   x ", "x"), ("<result>open", "<result>open")])
def test_result_block(spark, raw, want):
    assert one(spark, text.result_block(F.col("c")), c=raw) == want


def test_fenced_result_and_empty_marker(spark):
    assert one(spark, text.result_block(F.col("c"), fence="result"), c="x\n```result\n5\n```") == "5"
    assert one(spark, text.result_block(F.col("c"), empty=schemas.ERROR_NO_RESULT), c="") == "ERROR: LLM returned no result"


@pytest.mark.parametrize("raw", ["", "a", "a\n", "a\nb", "a\r\nb\rc\n", "\n", "\n\n", "a\n\nb"])
def test_file_lines(spark, raw):
    import io

    want = [x.rstrip("\n") for x in io.StringIO(raw, newline=None)]
    assert one(spark, text.file_lines(F.col("c")), c=raw) == want


def test_strip_matches_python(spark):
    rng = random.Random(1)
    parts = [" ", "\t", "\n", " ", " ", "\x1c", "　", "a", "b c", "\x0b", "\x85"]
    rows = [("".join(rng.choices(parts, k=rng.randrange(7))),) for _ in range(200)]
    got = spark.createDataFrame(rows, "c string").select("c", text.strip(F.col("c")).alias("x")).collect()
    assert all(r.x == r.c.strip() for r in got)


def test_key_values(spark):
    lines = ["'a': {'k': 1}", " \"b\" : 2 ", "no colon", "", "'a': 3", ":x", "'c':"]
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate(lines)], "task string, line_no int, value string")
    assert {r["var"]: r["value"] for r in text.key_values(rows, ["task"]).collect()} == {"a": "3", "b": "2", "": "x", "c": ""}


@pytest.mark.parametrize("raw,want", [("[B0, B1]", ["B0", "B1"]), ("['B0', \"B12\"]", ["B0", "B12"]), ("[]", []), ("oops(", [])])
def test_sequences(spark, raw, want):
    assert one(spark, text.list_items(F.col("c")), c=raw) == want
    assert programs.sequence_items(raw) == want


def test_sequence_of_other_values():
    assert programs.sequence_items("[1, None, [2, 3]]") == ["1", "None", "[2, 3]"]
    assert programs.sequence_items("7") == ["7"] and programs.sequence_items("None") == []


@pytest.mark.parametrize("source,want", [("x.result.append(1)", "result"), ("f.write(str(result))", "result"), ("def f():\n    return total", "total"), ("pass", "result"), ("return (1)", "result")])
def test_output_variable(spark, source, want):
    assert one(spark, text.output_variable(F.col("c")), c=source) == want


def test_test_field_and_router(spark):
    raw = "import x\ninputs = [[1]]\nresults = [2]\nfor i in inputs:\n    assertion(f(1), 2, 0) # more"
    assert one(spark, text.test_field(F.col("c")), c=raw).split("\n")[0] == "inputs = [[1]]"
    assert one(spark, text.test_field(F.col("c")), c="assertion(f(1), 2)") == "assertion(f(1)"
    assert one(spark, text.input_literal(F.col("c")), c=raw) == "[[1]]"
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate(["x = 1", "results = [1, 2]", "for a in b:", "assertion(f(1)]"])], "task string, line_no int, value string")
    got = text.combined_script(text.routed_lines(rows, ["task"]), ["task"]).first()
    assert got.script == "x = 1\nresult = []\nfor inp in inputs:\n    result.append(])" and got.results == "[1, 2]"


@pytest.mark.parametrize("span,want", [(("num[mid] += carry", 1, 0, 1, 17), "var_iid_9"), (("x //= 2", 1, 0, 1, 7), "x"), (("left_smaller = False", 1, 0, 1, 20), "left_smaller"), (("for k in range(3):", 1, 0, 1, 18), "k"), (("  abc  ", 1, 2, 1, 5), "abc"), (("a == b", 1, 0, 1, 6), "var_iid_9"), (("q = [\n 1]", 1, 0, 2, 3), "q")])
def test_variable_of_span(spark, span, want):
    cols = [F.col(c) for c in "sabcd"]
    got = spark.createDataFrame([(*span, 9)], "s string, a int, b int, c int, d int, i int").select(text.variable_of_span(*cols, F.col("i")).alias("x")).first().x
    assert got == want


def test_task_ids_and_numbers(spark):
    assert one(spark, text.task_ids(F.col("c")), c="10, task_2,2,,task_10 , 7") == ["task_2", "task_7", "task_10"]
    assert one(spark, text.task_number(F.col("c")), c="task_12") == 12 and one(spark, text.task_number(F.col("c")), c="x") is None


def test_split_items(spark):
    assert one(spark, text.split_items(F.col("c")), c="1 2  3\n") == ["1", "2", "3"]
    assert one(spark, text.split_items(F.col("c"), "trace"), c="'a': [1, 2] 'b': [3]") == ["'a': [1, 2]", "'b': [3]"]
    assert one(spark, text.split_items(F.col("c")), c="1 2\n3 4") == ["1 2", "3 4"]


def test_assigned_input_and_replacement(spark):
    assert one(spark, text.assigned_input(F.col("c")), c="x = 1\n  inputs =  [1,   2]  # why\ninputs = 3") == "[1, 2]"
    assert one(spark, text.assigned_input(F.col("c")), c="none") is None
    source = "inputs = 1\ny\ninputs = 2\n"
    assert one(spark, text.with_inputs_line(F.col("c"), F.lit("inputs = $9")), c=source) == "inputs = $9\ny\ninputs = 2\n"
    assert one(spark, text.with_inputs_line(F.col("c"), F.lit("I"), True), c=source) == "I\ny\nI\n"


@pytest.mark.parametrize("literal,n", [("[1, 2]", 2), ("[[1, 2], 'a,b']", 2), ("()", 0), ("(1,)", 1), ("5", 1), ("'x, y'", 1), ("{1: 2}", 1), ("[{'a': [1, 2]}, (3, 4), \"z,\"]", 3)])
def test_arity(spark, literal, n):
    assert one(spark, text.literal_arity(F.col("c")), c=literal) == n == programs.arity(literal)


def test_long_texts_end(spark):
    long = "x" + " " * 200_000 + "y" + " " * 200_000
    assert one(spark, text.strip(F.col("c")), c=long) == long.rstrip()
    assert one(spark, text.literal_arity(F.col("c")), c="['" + "a\\'" * 3000 + "', \"" + "b" * 200_000 + "\"]") == 2


def test_percent_and_dictionary(spark):
    assert spark.range(1).select(text.percent(F.lit(1), F.lit(3)).alias("x")).first().x == "33.33%"
    assert spark.range(1).select(text.percent(F.lit(1), F.lit(0)).alias("x")).first().x == "n/a"
    assert spark.sql("SELECT map('a', array('1', '2')) AS m").select(text.dictionary_lines(F.col("m")).alias("x")).first().x == "'a': [1, 2]"


def test_sources_and_sinks(spark, tmp_path):
    for task, lines in (("task_2", "a\nb\n"), ("task_10", ""), ("task_3", "ERROR: empty")):
        (tmp_path / task).mkdir()
        (tmp_path / task / "results.txt").write_text(lines)
        (tmp_path / task / "inputs.txt").write_text(" 1 \n\n 2\n")
    root = f"file://{tmp_path}"
    found = files.result_lines(spark, root, "results.txt", "original", "local")
    assert sorted((r.task_id, r.line_no, r.value) for r in found.collect()) == [("task_2", 1, "a"), ("task_2", 2, "b"), ("task_3", 1, "ERROR: empty")]
    listed = files.listing(spark, root, "results.txt")
    assert [r.task_id for r in files.tasks_of(listed).collect()] == ["task_10", "task_2", "task_3"]
    assert [r.task_id for r in files.tasks_of(listed, 2, numeric=True).collect()] == ["task_2", "task_3"]
    assert sorted((r.line_no, r.literal) for r in files.input_literals(spark, root, "inputs.txt").where("task_id = 'task_2'").collect()) == [(1, "1"), (2, "2")]
    assert [r.task_id for r in sinks.error_files(files.whole_texts(spark, root, "results.txt")).collect()] == ["task_3"]
    out = f"{root}/out"
    assert sinks.resume(found, out, ["task_id"]).count() == 3
    assert sinks.resume(found, out, ["task_id"]).count() == 3
    assert sinks.text_lines(found, ["task_id"]).where("task_id = 'task_2'").first().text == "a\nb\n"
    os_value = files.from_environment("${TRACELOOM_NOT_SET}")
    assert os_value == "" and files.from_environment("plain") == "plain"


def test_repair_report(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"started_at":"a","finished_at":"b","model_name":"m","selected_task_count":1,"discovered":{"failed_or_timeout":["task_1"],"empty_compare":[],"fully_same":[]},"results":[{"task_id":"task_1","status":"fixed","attempts":[{"attempt":1,"ok":false,"reason":"timeout","diff_indices":[]},{"attempt":2,"ok":true,"reason":"","diff_indices":[0,2]}],"diff_count":2,"diff_indices":[0,2],"old_hash":"x","new_hash":"y","deleted_llm_output":null}]}')
    (row,) = files.repair_results(spark, f"file://{tmp_path}").collect()
    assert row.task_id == "task_1" and [a.ok for a in row.attempts] == [False, True] and row.attempts[1].diff_indices == [0, 2]


def test_regex_guard():
    assert re.fullmatch(text.OUTPUT_ENDS, "\u2028") and re.fullmatch(text.OUTPUT_ENDS, "\r\n") and not re.fullmatch(text.OUTPUT_ENDS, " ")


def test_arity_at_any_depth(spark):
    rows = [("[" * 20 + "1, 2" + "]" * 20, 1), ("[" + "(" * 12 + "1, 2" + ")" * 12 + ", {1: [2, 3]}, 'a,]\\', b', \"x'y,\",]", 4), ("[ ]", 0), ("()", 0), ("[1,]", 1), ("'a, b'", 1), ("[\n1,\n2\n]", 2), ("5", 1), ("[[], []]", 2), ("['', '']", 2)]
    got = spark.createDataFrame(rows, "x string, n int").select("n", text.literal_arity(F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [n for _, n in rows]
