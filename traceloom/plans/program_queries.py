"""Queries over programs: parsed, run and traced tasks.

The programs are made of the driver's tables (adapters.program_tasks); without a folder of tables they are three toys. SQL
can't parse or run a program, but it can say what these programs' blocks, functions and outputs are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import prompts, text
from traceloom.operators import execute, programs, sequence
from traceloom.plans import adapters as A
from traceloom.plans import toys

QUERIES: dict = {}
ORACLES: dict = {}
TIMEOUT = 4.0


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + A.TASKS_SQL + sql
        return f

    return add


def _tasks(spark, sf_dir):
    return A.program_tasks(spark, sf_dir) if sf_dir else toys.tasks(spark)

#: Blocks of the programs by kind: id, type, first and last line, the lines held, successors, source.
_PLAIN = [
    ("B0", "entry", 1, 1, "1", "B1", "def helper(x, y=1):"), ("B1", "return", 2, 2, "2", "", "    return x * {n}"),
    ("B2", "entry", 5, 5, "5", "B3", "def fun1(n):"), ("B3", "normal", 6, 6, "6", "B4", "    result = 0"),
    ("B4", "loop_head", 7, 7, "7", "B5,B11", "    for i in range(n):"),
    ("B5", "loop_body", 8, 11, "8,9,10,11", "B6", "        if i % 2 == 0:\n            result += i\n        else:\n            result -= {n}"),
    ("B6", "condition", 8, 8, "8", "B7,B9", "        if i % 2 == 0:"), ("B7", "then", 9, 9, "9", "B8", "            result += i"),
    ("B8", "normal", 9, 9, "", "", "            result += i"), ("B9", "else", 11, 11, "11", "B10", "            result -= {n}"),
    ("B10", "normal", 11, 11, "", "B4", "            result -= {n}"), ("B11", "return", 12, 12, "12", "", "    return result"),
]
_ENDLESS = [
    ("B0", "entry", 1, 1, "1", "B1", "def fun1(n):"), ("B1", "loop_head", 2, 2, "2", "B2,B4", "    while True:"), ("B2", "loop_body", 3, 3, "3", "B3", "        n += {n}"),
    ("B3", "normal", 3, 3, "", "B1", "        n += {n}"), ("B4", "return", 4, 4, "4", "", "    return n"),
]


def _values() -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    rows = [(kind, *b) for kind, blocks in (("plain", _PLAIN), ("endless", _ENDLESS)) for b in blocks]
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_BLOCKS = f""",
    shapes(kind, block_id, block_type, line_start, line_end, lines, successors, source_snippet) AS (VALUES {_values()}),
    blocks AS (SELECT task_id, block_id, block_type, line_start, line_end, lines, successors, replace(source_snippet, '{{n}}', n::VARCHAR) AS source_snippet FROM tasks JOIN shapes USING (kind))"""
_FILL = lambda text: "replace('" + text.replace("'", "''") + "', '{n}', n::VARCHAR)"
_CODE = f", code AS (SELECT *, CASE kind WHEN 'broken' THEN {_FILL(A.BROKEN)} WHEN 'endless' THEN {_FILL(A.ENDLESS)} ELSE {_FILL(A.PROGRAM)} END AS code FROM tasks)"
#: What fun1 of a plain program gives for an input k: the even numbers below k, less n for each odd one.
_RESULT = "(((k + 1) // 2) * ((k + 1) // 2 - 1) - n * (k // 2))"
_RUNS = _CODE + f""",
    cases AS (SELECT n, task_id, kind, 1 AS line_no, n AS k FROM tasks UNION ALL SELECT n, task_id, kind, 2, 3 FROM tasks UNION ALL SELECT n, task_id, kind, 3, 0 FROM tasks),
    outputs AS (SELECT *, {_RESULT}::VARCHAR AS value FROM cases WHERE kind = 'plain')"""

_TEXTS = _CODE + _BLOCKS + """,
    shown AS (SELECT task_id, string_agg('[' || block_id || '] ' || rpad(block_type, 12, ' ') || ' line ' || line_start || '-' || line_end || ':  ' || replace(source_snippet, chr(10), chr(10) || repeat(' ', 22)), chr(10) ORDER BY line_start, substr(block_id, 2)::INTEGER) AS cfg FROM blocks GROUP BY task_id),
    asked AS (SELECT task_id, cfg, code, CASE kind WHEN 'broken' THEN n::VARCHAR WHEN 'endless' THEN 'n' ELSE 'x' END AS v FROM code LEFT JOIN shown USING (task_id))"""
_ANSWER = "chr(10) || chr(10) || 'Give the answer between <result> and </result> and nothing else.'"


@query(_BLOCKS + " SELECT * FROM blocks")
def cfg_blocks(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return programs.cfg_blocks(_tasks(spark, sf_dir), ["task_id"]).select("task_id", "block_id", "block_type", "line_start", "line_end", joined("lines"), joined("successors"), "source_snippet")


@query(_BLOCKS + " SELECT task_id, block_id AS src, unnest(string_split(successors, ',')) AS dst FROM blocks WHERE successors <> ''")
def cfg_edges(spark, sf_dir):
    return programs.cfg_edges(programs.cfg_blocks(_tasks(spark, sf_dir), ["task_id"]), ["task_id"])


@query(_BLOCKS + """, ranks(block_type, rank) AS (VALUES ('entry', 0), ('normal', 1), ('loop_head', 2), ('loop_body', 3), ('try', 3), ('then', 4), ('else', 4), ('condition', 5), ('return', 6)),
    held AS (SELECT task_id, block_id, block_type, unnest(string_split(lines, ','))::INTEGER AS line_no FROM blocks WHERE lines <> '')
    SELECT task_id, line_no, arg_max(block_id, rank) AS block_id FROM held JOIN ranks USING (block_type) GROUP BY task_id, line_no""")
def cfg_lines(spark, sf_dir):
    return programs.cfg_lines(programs.cfg_blocks(_tasks(spark, sf_dir), ["task_id"]), ["task_id"])


@query(_TEXTS + " SELECT task_id, cfg, 'These are the basic blocks of the program below:' || chr(10) || coalesce(cfg, '(no blocks)') || chr(10) || chr(10) || 'Program:' || chr(10) || code || chr(10) || chr(10) || 'Give the blocks in the order in which they run as ''block_sequence'': [...], and the values of ' || v || ' as ''' || v || ''': [...].' || " + _ANSWER + " AS prompt FROM asked")
def cfg_prompt_text(spark, sf_dir):
    blocks = programs.cfg_blocks(_tasks(spark, sf_dir), ["task_id"])
    cfg = programs.cfg_text(blocks, ["task_id"])
    rows = _tasks(spark, sf_dir).join(cfg, "task_id", "left").withColumn("output_var", text.output_variable(F.col("code")))
    return rows.select("task_id", "cfg", prompts.predict_blocks(F.col("code"), F.coalesce("cfg", F.lit("(no blocks)")), F.col("output_var")).alias("prompt"))


@query(_BLOCKS + """, one AS (SELECT task_id, block_id, '"' || block_id || '":{"block_id":"' || block_id || '","block_type":"' || block_type || '","line_start":' || line_start || ',"line_end":' || line_end || ',"lines":[' || lines || '],"successors":[' || CASE WHEN successors = '' THEN '' ELSE '"' || replace(successors, ',', '","') || '"' END || '],"source_snippet":' || to_json(source_snippet)::VARCHAR || '}' AS j FROM blocks)
    SELECT task_id, '{"output_var":"result","blocks":{' || string_agg(j, ',' ORDER BY block_id) || '}}' AS json FROM one GROUP BY task_id""")
def cfg_json(spark, sf_dir):
    return programs.cfg_json(programs.cfg_blocks(_tasks(spark, sf_dir), ["task_id"]), ["task_id"])


@query(", f(kind, ordinal, name, required, \"positional\", any_number) AS (VALUES ('plain', 0, 'helper', 1, 2, false), ('plain', 1, 'fun1', 1, 1, false), ('endless', 0, 'fun1', 1, 1, false)) SELECT task_id, ordinal, name, required, \"positional\", any_number FROM tasks JOIN f USING (kind)")
def ast_functions(spark, sf_dir):
    return programs.functions(_tasks(spark, sf_dir), ["task_id"])


@query(" SELECT task_id, 'fun1' AS name FROM tasks WHERE kind <> 'broken'")
def callable_choice(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    inputs = programs.test_inputs(tasks, ["task_id"]).withColumn("arity", text.literal_arity(F.col("literal")))
    return programs.callable_functions(programs.functions(tasks, ["task_id"]), inputs.select("task_id", "arity"), programs.entry_names(tasks, ["task_id"]), ["task_id"])


@query(_CODE + " SELECT task_id, kind = 'endless' AS syntax_ok FROM code")
def syntax_gate(spark, sf_dir):
    return programs.syntax_gate(_tasks(spark, sf_dir), "rejected").select("task_id", "syntax_ok")


@query(_RUNS + " SELECT task_id, line_no, '[' || k || ']' AS literal FROM cases")
def test_input_literals(spark, sf_dir):
    return programs.parsed_inputs(programs.test_inputs(_tasks(spark, sf_dir), ["task_id"])).select("task_id", "line_no", "literal")


@query(_RUNS + " SELECT task_id, line_no, k::INTEGER AS first, '[' || k || ']' AS shown FROM cases WHERE k >= 3")
def input_values(spark, sf_dir):
    rows = programs.input_values(programs.test_inputs(_tasks(spark, sf_dir), ["task_id"]))
    first = programs.value_at(F.col("value"), "$[0]", "int")
    return rows.where(first >= 3).select("task_id", "line_no", first.alias("first"), programs.value_text(F.col("value")).alias("shown"))


def _scripts(spark, sf_dir, code="code"):
    tasks = _tasks(spark, sf_dir).select("task_id", F.col(code).alias("code"), "test", "test_list")
    return execute.spliced(tasks.join(programs.entry_names(tasks, ["task_id"]), "task_id"), programs.test_inputs(tasks, ["task_id"]), ["task_id"])


@query(_RUNS + " SELECT task_id, CASE kind WHEN 'broken' THEN 'missing' WHEN 'endless' THEN 'timeout' ELSE 'success' END AS status, coalesce(string_agg(value, chr(10) ORDER BY line_no) || chr(10), '') AS output FROM tasks LEFT JOIN outputs USING (n, task_id, kind) GROUP BY task_id, kind")
def sandbox_exec(spark, sf_dir):
    return execute.run_scripts(_scripts(spark, sf_dir), ["task_id"], timeout=TIMEOUT).select("task_id", "status", "output")


@query(""", kinds(name, ok, reason, diff_indices) AS (VALUES ('equivalent', false, 'no output differs', ''), ('non_equivalent', true, '', '0,1'), ('rejected', false, 'syntax', ''))
    SELECT task_id, name AS kind, ok, reason, diff_indices FROM tasks, kinds WHERE kind = 'plain'""")
def candidate_gate(spark, sf_dir):
    original = execute.output_lines(execute.run_scripts(_scripts(spark, sf_dir), ["task_id"], timeout=TIMEOUT), ["task_id"])
    original = sequence.collected(original, ["task_id"], "line_no", "value", "original")
    literals = sequence.collected(programs.test_inputs(_tasks(spark, sf_dir), ["task_id"]), ["task_id"], "line_no", "literal", "literals")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("candidate")) for k in ("equivalent", "non_equivalent", "rejected")]))
    rows = _tasks(spark, sf_dir).select("task_id", kinds.alias("c")).select("task_id", "c.*").join(original, "task_id").join(literals, "task_id")
    judged = execute.gate(rows, ["task_id", "kind"], timeout=TIMEOUT)
    return judged.withColumn("reason", F.split("reason", ":")[0]) if not sf_dir else judged.select("task_id", "kind", "ok", F.split("reason", ":")[0].alias("reason"), F.array_join(F.col("diff_indices").cast("array<string>"), ",").alias("diff_indices"))


@query(_RUNS + f""", calls AS (SELECT * FROM cases WHERE kind = 'plain'),
    steps AS (
        SELECT task_id, 'n' AS var, line_no, 0 AS i, k::VARCHAR AS value FROM calls
        UNION ALL SELECT task_id, 'one', line_no, 0, '[' || k || ']' FROM calls
        UNION ALL SELECT task_id, 'i', line_no, i, i::VARCHAR FROM (SELECT *, unnest(range(0, k))::INTEGER AS i FROM calls)
        UNION ALL SELECT task_id, 'one', 1, 0, '[1]' FROM tasks WHERE kind = 'endless'
        UNION ALL SELECT task_id, 'n', 1, i, i::VARCHAR FROM (SELECT task_id, unnest(range(1, 998))::INTEGER AS i FROM tasks WHERE kind = 'endless')
        UNION ALL SELECT task_id, 'result', line_no, k::INTEGER, {_RESULT}::VARCHAR FROM (SELECT task_id, line_no, n, unnest(range(0, k + 1)) AS k FROM calls)
    ),
    new AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY task_id, var ORDER BY line_no, i) AS before FROM steps) WHERE value IS DISTINCT FROM before)
    SELECT task_id, var, string_agg(value, ' ' ORDER BY line_no, i) AS values FROM new GROUP BY task_id, var""")
def program_variable_changes(spark, sf_dir):
    events = sequence.traced(execute.trace_events(_scripts(spark, sf_dir), ["task_id"], timeout=TIMEOUT, most=2000).where("var IS NOT NULL"))
    new = sequence.changes(events, ["task_id", "var"], "step", "value")
    found = sequence.collected(new, ["task_id", "var"], "step", "value", "values")
    return found.withColumn("values", F.array_join("values", " ")) if sf_dir else found


@query(_RUNS + f""", calls AS (SELECT * FROM cases WHERE kind = 'plain'),
    written AS (
        SELECT task_id, 'inputs' AS var, 0 AS line_no, 0 AS i, '[[' || n || '], [3], [0]]' AS value FROM tasks WHERE kind <> 'broken'
        UNION ALL SELECT task_id, 'one', line_no, 0, '[' || k || ']' FROM calls
        UNION ALL SELECT task_id, 'i', line_no, i, i::VARCHAR FROM (SELECT *, unnest(range(0, k))::INTEGER AS i FROM calls)
        UNION ALL SELECT task_id, 'result', line_no, k::INTEGER, {_RESULT}::VARCHAR FROM (SELECT task_id, line_no, n, unnest(range(0, k + 1)) AS k FROM calls)
        UNION ALL SELECT task_id, 'one', 1, 0, '[1]' FROM tasks WHERE kind = 'endless'
        UNION ALL SELECT task_id, 'n', 1, i, i::VARCHAR FROM (SELECT task_id, unnest(range(2, 2000))::INTEGER AS i FROM tasks WHERE kind = 'endless')
    )
    SELECT task_id, var, string_agg(value, ' ' ORDER BY line_no, i) AS values FROM written GROUP BY task_id, var""")
def program_writes(spark, sf_dir):
    made = execute.instrumented(_scripts(spark, sf_dir), ["task_id"], "script")
    events = execute.write_events(execute.write_runs(made, ["task_id"], timeout=TIMEOUT, most=2000), execute.spans_of(made, ["task_id"]), ["task_id"])
    found = sequence.writes(events, ["task_id"], "step", "var", "value")
    return found.withColumn("values", F.array_join("values", " ")) if sf_dir else found


@query("""
    , places(kind, variable, line, col, till) AS (VALUES ('plain', 'result', 6, 4, 10), ('plain', 'i', 7, 8, 9), ('plain', 'result', 9, 12, 18), ('plain', 'result', 11, 12, 18), ('endless', 'n', 3, 8, 9))
    SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY line)::VARCHAR AS iid, variable, line AS start_line, col AS start_column, line AS end_line, till AS end_column FROM tasks JOIN places USING (kind)""")
def write_spans(spark, sf_dir):
    return execute.spans_of(execute.instrumented(_tasks(spark, sf_dir), ["task_id"]), ["task_id"])


@query()
def program_block_trace(spark, sf_dir):
    events = execute.trace_events(_scripts(spark, sf_dir), ["task_id"], timeout=TIMEOUT, most=2000)
    lines = execute.line_events(events, ["task_id"], ["fun1"], "result")
    owned = programs.cfg_lines(programs.cfg_blocks(_scripts(spark, sf_dir), ["task_id"], "script"), ["task_id"])
    return sequence.block_traces(sequence.line_blocks(lines, owned, ["task_id"]), ["task_id"], "step", "block_id", "value", cap=500)


@query(""" SELECT task_id, CASE WHEN n % 3 = 2 THEN 'empty' ELSE 'ok' END AS status, CASE n % 3 WHEN 0 THEN n::VARCHAR WHEN 1 THEN 'no tag' ELSE 'ERROR: empty' END AS result FROM tasks""")
def replay_prediction(spark, sf_dir):
    answers = {"task_1": ["<result>\n-1\n1\n0\n</result>"], "task_2": ["no tag "]}  # of the toys
    if sf_dir:
        answers = {f"task_{n}": ["<result>\n" + str(n) + " \n</result> <result>2</result>"] if n % 3 == 0 else [" no tag\n"] for n in range(200) if n % 3 < 2}
    asked = _scripts(spark, sf_dir).select("task_id", prompts.predict_output(F.col("script")).alias("prompt"))
    return execute.predict(asked, ["task_id"], lambda: execute.Replay(answers), tries=1).select("task_id", "status", "result")


@query(_CODE + """ SELECT task_id, 'fixed' AS status, 3 AS attempts, 'syntax|no output differs|' AS reasons, replace(code, 'result += i', 'result += i + 1') AS code FROM code WHERE kind = 'plain'""")
def repair_loop(spark, sf_dir):
    original = execute.output_lines(execute.run_scripts(_scripts(spark, sf_dir), ["task_id"], timeout=TIMEOUT), ["task_id"])
    original = sequence.collected(original, ["task_id"], "line_no", "value", "original")
    literals = sequence.collected(programs.test_inputs(_tasks(spark, sf_dir), ["task_id"]), ["task_id"], "line_no", "literal", "literals")
    rows = _tasks(spark, sf_dir).select("task_id", "code").join(original, "task_id").join(literals, "task_id")
    rows = rows.withColumn("prompt", prompts.non_equivalent(F.col("code"), F.array_join("literals", "\n")))
    # stored answers, one program for each size of a part: a few dozen
    answers = {r.task_id: [r.rejected, r.equivalent, r.non_equivalent] for r in _tasks(spark, sf_dir).select("task_id", "rejected", "equivalent", "non_equivalent").toLocalIterator()}
    fixed = execute.repair(rows, ["task_id"], lambda: execute.Replay(answers), attempts=4, timeout=TIMEOUT)
    if not sf_dir:
        return fixed
    reasons = F.array_join(F.transform("attempts", lambda a: F.split(a["reason"], ":")[0]), "|")
    return fixed.select("task_id", "status", F.size("attempts").alias("attempts"), reasons.alias("reasons"), "code")


#: Blocks of adapters.SHAPES: handlers, the else of a loop and inner functions are not followed, code after return is.
_SHAPED = [
    ("B0", "entry", 1, 1, "1", "B1"), ("B1", "try", 3, 8, "3,4,5,6,7,8", "B2"), ("B2", "loop_head", 3, 3, "", "B3,B13"), ("B3", "loop_body", 4, 8, "", "B4"), ("B4", "loop_head", 4, 4, "", "B5,B2"),
    ("B5", "loop_body", 5, 8, "", "B6"), ("B6", "condition", 5, 5, "5", "B7,B9"), ("B7", "then", 6, 6, "6", "B8"), ("B8", "return", 6, 6, "6", ""), ("B9", "else", 7, 8, "7,8", "B10"),
    ("B10", "condition", 7, 7, "7", "B11"), ("B11", "then", 8, 8, "", "B12"), ("B12", "normal", 8, 8, "", "B4"), ("B13", "normal", 11, 15, "11,12,13,14,15", "B14"), ("B14", "return", 16, 16, "16", "B15"),
    ("B15", "normal", 17, 17, "17", ""), ("B16", "entry", 21, 21, "21", "B17"), ("B17", "normal", 22, 23, "22,23", "B18"), ("B18", "loop_head", 24, 24, "24", "B19,B21"), ("B19", "loop_body", 25, 25, "25", "B20"),
    ("B20", "normal", 25, 25, "", "B18"), ("B21", "condition", 28, 28, "28", "B22"), ("B22", "then", 29, 29, "29", "B23"), ("B23", "normal", 29, 29, "", "B24"), ("B24", "return", 30, 30, "30", ""),
]
_SHAPED_WRITES = [(3, "i"), (4, "j"), (10, "n"), (11, "f"), (12, "n"), (15, "n"), (17, "n"), (25, "x"), (27, "x"), (29, "x")]


def _shapes(spark, sf_dir):
    filled = F.replace(F.lit(A.SHAPES), F.lit("{n}"), F.col("n").cast("string"))
    return _sizes(spark, sf_dir).select(F.concat(F.lit("task_"), F.col("n").cast("string")).alias("task_id"), filled.alias("code"))


def _sizes(spark, sf_dir):
    rows = A.table(spark, sf_dir, "part").select(F.col("p_size").alias("n")) if sf_dir else spark.range(1, 4).select(F.col("id").cast("int").alias("n"))
    return rows.where("n IS NOT NULL").distinct()


_TUPLES = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


@query(f", shaped(block_id, block_type, line_start, line_end, lines, successors) AS (VALUES {_TUPLES(_SHAPED)}) SELECT task_id, shaped.* FROM tasks, shaped")
def cfg_shapes(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return programs.cfg_blocks(_shapes(spark, sf_dir), ["task_id"]).select("task_id", "block_id", "block_type", "line_start", "line_end", joined("lines"), joined("successors"))


@query(f""", shaped(name, kind, line_start, line_end, lines, successors) AS (VALUES {_TUPLES(_SHAPED)}), written(line, name) AS (VALUES {_TUPLES(_SHAPED_WRITES)})
    SELECT task_id, 'block' AS part, name, shaped.kind, line_start, line_end FROM tasks, shaped UNION ALL SELECT task_id, 'function', 'outer', NULL, NULL, NULL FROM tasks
    UNION ALL SELECT task_id, 'write', name, NULL, line, line FROM tasks, written""")
def program_parts(spark, sf_dir):
    return programs.program_parts(_shapes(spark, sf_dir), ["task_id"]).select("task_id", "part", "name", "kind", "line_start", "line_end")


@query(""" SELECT task_id, CASE WHEN n % 5 = 0 THEN 'one' WHEN n % 5 IN (1, 2) THEN 'two' WHEN n % 5 = 3 THEN 'many' ELSE 'last' END AS name FROM tasks""")
def callable_fallbacks(spark, sf_dir):
    tasks = _sizes(spark, sf_dir).select(F.concat(F.lit("task_"), F.col("n").cast("string")).alias("task_id"), "n")
    # one input of n % 5 arguments and, for some tasks, a second of one more; the last function takes none
    any_number = F.when(F.col("n") % 5 == 3, "def many(a, *b): pass\n").otherwise("")
    code = F.concat(F.lit("def one(a=0): pass\ndef two(a, b=1): pass\n"), any_number, F.when(F.col("n") % 5 == 0, "def one(a=0): pass\n").otherwise(""), F.when(F.col("n") % 5 > 2, "def last(*, k=1): pass\n").otherwise(""))
    sizes = tasks.select("task_id", F.explode(F.when(F.col("n") % 5 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("n") % 5))).alias("arity"))
    none = tasks.select("task_id", F.lit("absent").alias("preferred"))
    return programs.callable_functions(programs.functions(tasks.withColumn("code", code), ["task_id"]), sizes, none, ["task_id"])
