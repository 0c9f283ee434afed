"""Queries over the text and parse expressions, prompts, sinks and small roll-ups, with their oracle SQL.

Each makes texts of the driver's tables, whole, in the shape that the operator reads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import prompts, text
from traceloom.operators import compare, execute, programs, rollup, sequence
from traceloom.plans import adapters as A
from traceloom.sources import files, sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _part(spark, sf_dir, **columns):
    return A.table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in columns.items()])


_TEST = "'import x\\ninputs = [[' || p_size || '], [\"' || p_brand || '\"]]\\nresults = [1]\\nassertion(f(' || p_size || '), 1), 0)\\nassertion(' || p_name || ')'"
_SQL_TEST = "'import x' || chr(10) || 'inputs = [[' || p_size || '], [\"' || p_brand || '\"]]' || chr(10) || 'results = [1]' || chr(10) || 'assertion(f(' || p_size || '), 1), 0)' || chr(10) || 'assertion(' || p_name || ')'"
_FIELD = "array_to_string(list_transform(string_split(substr(t, strpos(t, 'inputs')), chr(10)), lambda x: CASE WHEN contains(x, 'assertion') THEN split_part(x, ')', 1) || ')' ELSE x END), chr(10))"


@query(f"SELECT p_partkey, {_FIELD} AS test FROM (SELECT p_partkey, {_SQL_TEST} AS t FROM part)")
def test_field_text(spark, sf_dir):
    return _part(spark, sf_dir, t=_TEST).select("p_partkey", text.test_field(F.col("t")).alias("test"))


@query(f"SELECT p_partkey, {_FIELD} || chr(10) || p_name AS test FROM (SELECT p_partkey, p_name, {_SQL_TEST} AS t FROM part)")
def test_list_text(spark, sf_dir):
    return _part(spark, sf_dir, t=f"array({_TEST}, p_name)").select("p_partkey", text.test_fields(F.col("t")).alias("test"))


@query("SELECT p_partkey, '[[' || p_size || '], [\"' || p_brand || '\"]]' AS literal FROM part")
def input_literal_regex(spark, sf_dir):
    return _part(spark, sf_dir, t=_TEST).select("p_partkey", text.input_literal(F.col("t")).alias("literal"))


@query("SELECT p_partkey, 'B' || p_size || ',B' || (p_size % 7) || ',B2' AS items FROM part")
def block_list_items(spark, sf_dir):
    rows = _part(spark, sf_dir, t="' [\"B' || p_size || '\", B' || (p_size % 7) || ', \\'B2\\' ] '")
    return rows.select("p_partkey", F.array_join(text.list_items(F.col("t")), ",").alias("items"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'B' || p_size || '|B1' WHEN 1 THEN p_size || '|x' ELSE '' END AS items FROM part")
def sequence_literals(spark, sf_dir):
    t = "CASE p_size % 3 WHEN 0 THEN '[B' || p_size || ', B1]' WHEN 1 THEN '[' || p_size || ', \"x\"]' ELSE '[]' END"
    return _part(spark, sf_dir, t=t).select("p_partkey", F.array_join(text.as_strings(programs.sequence_column(F.col("t"))), "|").alias("items"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'result' WHEN 1 THEN 'result' WHEN 2 THEN 'v' || p_size ELSE 'result' END AS variable FROM part")
def output_variable_choice(spark, sf_dir):
    t = "CASE p_size % 4 WHEN 0 THEN 'a = []\\nresult . append(1)\\nreturn a' WHEN 1 THEN 'return b\\nf.write(str(result))' WHEN 2 THEN 'if x:\\n  return v' || p_size || '\\nreturn w' ELSE 'pass' END"
    return _part(spark, sf_dir, t=t).select("p_partkey", text.output_variable(F.col("t")).alias("variable"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'v' || p_size WHEN 1 THEN 'i' || p_size WHEN 2 THEN 'w' || p_size WHEN 3 THEN 'var_iid_' || p_partkey WHEN 4 THEN 'var_iid_' || p_partkey ELSE 'k' END AS name FROM part")
def span_variables(spark, sf_dir):
    code = "CASE p_size % 6 WHEN 0 THEN 'v' || p_size || ' = f(1)' WHEN 1 THEN 'for i' || p_size || ' in y:' WHEN 2 THEN 'w' || p_size || ' += 2' WHEN 3 THEN 'a == b' WHEN 4 THEN 'f(x)[0]' ELSE 'k' END"
    writes = _part(spark, sf_dir, path="p_type", iid="cast(p_partkey AS string)", line="p_size % 3 + 1", code=code)
    spans = writes.select("path", "iid", F.col("line").alias("start_line"), F.lit(2).alias("start_column"), F.col("line").alias("end_line"), (F.length("code") + 2).alias("end_column"))
    source = F.concat(F.repeat(F.lit("x\n"), F.col("line") - 1), F.lit("  "), F.col("code"), F.lit(" # end\nlast"))
    rows = files.span_names(writes.withColumn("source", source), spans)
    return rows.select("p_partkey", text.variable_of_span(*[F.col(c) for c in ("source", "start_line", "start_column", "end_line", "end_column", "iid")]).alias("name"))


@query("SELECT p_partkey, '[' || p_size || ', 2]' AS value FROM part")
def assigned_inputs(spark, sf_dir):
    return _part(spark, sf_dir, t="'a = 1\\n  inputs = [' || p_size || ',  2]   # of ' || p_name || '\\ninputs = 3'").select("p_partkey", text.assigned_input(F.col("t")).alias("value"))


@query("SELECT p_partkey, 'a = ' || p_size || chr(10) || 'inputs = [' || p_name || ']' || chr(10) || 'inp = 2' || chr(10) || 'inputs = 5' AS first, 'a = ' || p_size || chr(10) || 'inputs = [' || p_name || ']' || chr(10) || 'inp = 2' || chr(10) || 'inputs = [' || p_name || ']' AS every FROM part")
def replaced_inputs(spark, sf_dir):
    rows = _part(spark, sf_dir, t="'a = ' || p_size || '\\n  input = [1]\\ninp = 2\\ninputs = 5'", line="'inputs = [' || p_name || ']'")
    rows = rows.withColumn("t", F.replace("t", F.lit("input = [1]"), F.lit("inputs = [1]")))
    return rows.select("p_partkey", text.with_inputs_line(F.col("t"), F.col("line")).alias("first"), text.with_inputs_line(F.col("t"), F.col("line"), everywhere=True).alias("every"))


@query("SELECT p_partkey, p_size % 5 AS arity, 1 AS plain FROM part")
def literal_arities(spark, sf_dir):
    items = "array_join(transform(sequence(0, p_size % 5), i -> '(' || i || ', [\"a,b)\", {' || p_size || ': 2}])'), ', ')"
    rows = _part(spark, sf_dir, t=f"CASE WHEN p_size % 5 = 0 THEN '[ ]' ELSE '[' || substring_index({items}, '), ', p_size % 5) || ')' || ']' END", one="'\"' || p_name || ', x\"'")
    rows = rows.withColumn("t", F.when(F.endswith("t", F.lit("))]")), F.regexp_replace("t", r"\)\)\]$", ")]")).otherwise(F.col("t")))
    return rows.select("p_partkey", text.literal_arity(F.col("t")).alias("arity"), text.literal_arity(F.col("one")).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN 'task_7,task_100' ELSE array_to_string(list_transform(list_sort([p_size, 7, 100]), lambda n: 'task_' || n), ',') END AS ids FROM part")
def normalised_task_ids(spark, sf_dir):
    return _part(spark, sf_dir, t="' task_100, ' || p_size || ',,7 , task_' || p_size || ','").select("p_partkey", F.array_join(text.task_ids(F.col("t")), ",").alias("ids"))


@query("SELECT p_partkey, '''' || p_brand || ''': [' || p_size || ', 2]' || chr(10) || '''z'': []' AS lines, '''block_sequence'': [''B0'', ''B' || p_size || ''']' || chr(10) || '''result'': [' || p_size || ']' || chr(10) AS trace FROM part")
def rendered_traces(spark, sf_dir):
    rows = _part(spark, sf_dir, m="map(p_brand, array(cast(p_size AS string), '2'), 'z', array())", path="array('B0', 'B' || p_size)", vals="array(cast(p_size AS string))")
    return rows.select("p_partkey", text.dictionary_lines(F.col("m")).alias("lines"), text.block_trace_lines(F.col("path"), F.lit("result"), F.col("vals")).alias("trace"))


@query("SELECT p_partkey, '''a'': [' || p_size || ', 2]|''b c'': [''' || p_name || ''']' AS items, 2 AS n FROM part")
def split_trace_items(spark, sf_dir):
    rows = _part(spark, sf_dir, t="'  \\'a\\': [' || p_size || ', 2]   \\'b c\\': [\\'' || p_name || '\\']  '").select("p_partkey", text.split_items(F.col("t"), "trace").alias("x"))
    return rows.select("p_partkey", F.array_join("x", "|").alias("items"), F.size("x").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size <= 30 AND NOT contains(p_name, 'red') AND NOT contains(p_name, 'ring')")
def name_and_number_filter(spark, sf_dir):
    rows = _part(spark, sf_dir, task_id="'task_' || p_size", name="p_name")
    return rows.where(text.up_to(F.col("task_id"), 30) & text.none_of(F.col("name"), ["red", "ring"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def error_texts(spark, sf_dir):
    return sinks.error_files(_part(spark, sf_dir, text="CASE p_size % 3 WHEN 0 THEN ' ERROR: empty ' WHEN 1 THEN p_name ELSE 'ERROR: empty ' || p_name END")).select("p_partkey")


@query("WITH " + A.DOC_LINES_SQL + " SELECT doc_id, line_no, value FROM doc_lines WHERE NOT (line_no = 1 AND contains(value, 'th'))")
def pragma_stripped(spark, sf_dir):
    return sinks.without_pragma(A.doc_lines(spark, sf_dir), "th")


@query("WITH " + A.DOC_LINES_SQL + " SELECT doc_id, string_agg(value || chr(10), '' ORDER BY line_no) AS text FROM doc_lines GROUP BY doc_id")
def text_sink(spark, sf_dir):
    return sinks.text_lines(A.doc_lines(spark, sf_dir), ["doc_id"])


@query("SELECT p_type, p_brand, n, (row_number() OVER (PARTITION BY p_type ORDER BY n DESC, first_seen))::INTEGER AS place FROM (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY ALL)")
def sorted_by_count(spark, sf_dir):
    return rollup.by_count(_part(spark, sf_dir, p_type="p_type", p_brand="p_brand"), ["p_type"], "p_brand", "p_partkey")


@query("WITH " + A.TRACE_SQL + " SELECT run, coalesce(arg_min(block, step) FILTER (block <> 'click'), 'result') AS variable FROM trace GROUP BY run")
def output_variable_of_trace(spark, sf_dir):
    lines = A.event_trace(spark, sf_dir).select("run", F.col("step").alias("line_no"), F.format_string("'%s': [1]", F.when(F.col("block") == "click", "block_sequence").otherwise(F.col("block"))).alias("value"))
    return rollup.output_variables(lines, ["run"])


@query("SELECT l_returnflag AS flag, CASE WHEN count(*) FILTER (l_linestatus = 'F') = 0 THEN '0.00%' ELSE printf('%.2f%%', 100.0 * count(*) FILTER (l_linestatus = 'F') / count(*)) END AS share, 'n/a' AS nothing FROM lineitem GROUP BY l_returnflag")
def shares_in_percent(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(F.col("l_linestatus") == "F").alias("part"), F.count("*").alias("n"))
    return rows.select("flag", text.percent(F.col("part"), F.col("n")).alias("share"), text.percent(F.col("part"), F.lit(0)).alias("nothing"))


@query("SELECT o_custkey, CASE WHEN n > 5 THEN array_to_string(list_slice(ids, 1, 5), ', ') || ', and ' || (n - 5) || ' more' ELSE array_to_string(ids, ', ') END AS shown FROM (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY o_custkey)")
def shown_ids(spark, sf_dir):
    ids = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("ids"))
    return ids.select("o_custkey", text.shown(F.col("ids"), 5).alias("shown"))


@query("SELECT sum(files)::BIGINT AS files, sum(round_even(s, 4) * files) / sum(files) AS avg_similarity, sum(round_even(v, 4) * files) / sum(files) AS avg_value_accuracy FROM (SELECT p_type, count(*) AS files, avg(p_size / 64.0::DOUBLE) AS s, avg(p_retailprice / 4096.0::DOUBLE) AS v FROM part GROUP BY p_type)")
def rounded_label_means(spark, sf_dir):
    rows = _part(spark, sf_dir, label="p_type", s="p_size / 64.0D", v="p_retailprice / 4096.0D")
    return rollup.rounded_rollup(rows.groupBy("label").agg(F.count("*").alias("files"), F.avg("s").alias("avg_similarity"), F.avg("v").alias("avg_value_accuracy")))


@query("SELECT p_partkey, list_extract(v, 1)::VARCHAR AS first, len(v)::BIGINT AS n FROM (SELECT p_partkey, [p_name, p_brand] AS v FROM part)")
def combined_scripts(spark, sf_dir):
    lines = _part(spark, sf_dir, x="array(p_name, 'results = [' || p_size || ']', p_brand)").select("p_partkey", F.posexplode("x").alias("line_no", "value"))
    both = text.combined_script(text.routed_lines(lines, ["p_partkey"]), ["p_partkey"])
    return both.select("p_partkey", F.split("script", "\n")[0].alias("first"), F.size(F.split("script", "\n")).cast("bigint").alias("n"))


_SAY = "chr(10) || chr(10) || 'Give the answer between <result> and </result> and nothing else.'"
_NL, _GAP = "chr(10)", "chr(10) || chr(10)"


@query(f"""SELECT p_partkey,
    'Rewrite this Python program so that it reads differently and prints the same for every input. Keep its functions'' names.' || {_GAP} || p_name || {_SAY} AS equivalent,
    'Change this Python program in one small, natural way, so that at least one of the inputs below gives another output. It has to run without errors.' || {_GAP} || p_name || {_GAP} || 'Inputs, one per line:' || {_NL} || p_size || {_SAY} AS non_equivalent,
    'This change of a program was rejected: ' || p_type || {_GAP} || 'Original:' || {_NL} || p_name || {_GAP} || 'Rejected:' || {_NL} || p_brand || {_GAP} || 'Inputs:' || {_NL} || p_size || {_GAP} || 'Outputs of the original:' || {_NL} || p_partkey || {_GAP} || 'Write another version whose outputs differ on at least one input.' || {_SAY} AS repair,
    'The second program was to behave as asked of the first but doesn''t on these cases:' || {_NL} || p_type || {_GAP} || 'First:' || {_NL} || p_name || {_GAP} || 'Second:' || {_NL} || p_brand || {_GAP} || 'Correct the second.' || {_SAY} AS feedback,
    'What does this program print? One line per output, in order.' || {_GAP} || p_name || {_SAY} AS output,
    'List each variable of this program with the values that it takes in order, as ''name'': [values], one variable per line.' || {_GAP} || p_name || {_SAY} AS variables FROM part""")
def prompt_texts(spark, sf_dir):
    rows = _part(spark, sf_dir, a="p_name", b="p_brand", c="cast(p_size AS string)", d="p_type", e="cast(p_partkey AS string)")
    a, b, c, d, e = (F.col(x) for x in "abcde")
    return rows.select("p_partkey", prompts.equivalent(a).alias("equivalent"), prompts.non_equivalent(a, c).alias("non_equivalent"), prompts.repair(a, b, c, e, d).alias("repair"), prompts.feedback(a, b, d).alias("feedback"), prompts.predict_output(a).alias("output"), prompts.predict_variables(a).alias("variables"))


_CODE = "replace('" + A.PROGRAM.replace("'", "''") + "', '{n}', n::VARCHAR)"


@query("WITH " + A.TASKS_SQL + f"""
    SELECT task_id, {_CODE} || {_GAP} || {_NL} || 'inputs = [' || {_NL} || '    [' || n || '],' || {_NL} || '    [3],' || {_NL} || '    [0],' || {_NL} || ']' || {_GAP}
        || 'for one in inputs:' || {_NL} || '    print(fun1(*one) if isinstance(one, (list, tuple)) else fun1(one))' || {_NL} AS script FROM tasks WHERE kind = 'plain'""")
def spliced_scripts(spark, sf_dir):
    tasks = A.program_tasks(spark, sf_dir)
    made = execute.spliced(tasks.join(programs.entry_names(tasks, ["task_id"]), "task_id"), programs.test_inputs(tasks, ["task_id"]), ["task_id"])
    return made.where(F.contains("script", F.lit("def helper")))


@query("WITH " + A.TASKS_SQL + f" SELECT task_id, 'a = 1' || {_NL} || 'inputs = [' || {_NL} || '    [' || n || '],' || {_NL} || '    [3],' || {_NL} || '    [0],' || {_NL} || ']' || {_NL} || 'b = ' || n AS script FROM tasks")
def swapped_inputs(spark, sf_dir):
    tasks = A.program_tasks(spark, sf_dir)
    scripts = tasks.select("task_id", F.concat(F.lit("a = 1\ninputs = [\n  9,\n]\nb = "), F.regexp_extract("task_id", "[0-9]+", 0)).alias("script"))
    return programs.with_new_inputs(scripts, programs.test_inputs(tasks, ["task_id"]), ["task_id"])


@query("SELECT 'task_' || p_partkey AS task_id, CASE WHEN p_size % 2 = 0 THEN 'stored ' || p_name ELSE '[B0] entry        line 1-1:  def f(a):' || chr(10) || '[B1] return       line 2-2:      return ' || p_size END AS cfg FROM part")
def stored_or_built_graphs(spark, sf_dir):
    rows = _part(spark, sf_dir, task_id="'task_' || p_partkey", code="'def f(a):\\n    return ' || p_size", even="p_size % 2 = 0", text="'stored ' || p_name")
    return programs.stored_or_built(rows.select("task_id", "code"), rows.where("even").select("task_id", F.col("text").alias("cfg")), ["task_id"])


@query("WITH " + A.TASKS_SQL + ", k(i, block_id, line_no) AS (VALUES (0, 'B0', 1), (1, 'B1', 2)) SELECT 'task_' || n AS task_id, 'result' AS output_var, block_id, line_no AS line_start, 'B' || n AS successor FROM tasks, k")
def blocks_from_json(spark, sf_dir):
    rows = A.program_tasks(spark, sf_dir).select("task_id", F.concat(F.lit("B"), F.regexp_extract("task_id", "[0-9]+", 0)).alias("to"))
    one = lambda i: F.struct(F.lit(f"B{i}").alias("block_id"), F.lit("normal").alias("block_type"), F.lit(i + 1).alias("line_start"), F.lit(i + 1).alias("line_end"), F.array(F.lit(i + 1)).alias("lines"), F.array("to").alias("successors"), F.lit("x").alias("source_snippet"))
    blocks = rows.select("task_id", F.explode(F.array(one(0), one(1))).alias("b")).select("task_id", "b.*")
    back = programs.blocks_from_json(programs.cfg_json(blocks, ["task_id"]), ["task_id"])
    return back.select("task_id", "output_var", "block_id", "line_start", F.col("successors")[0].alias("successor"))


@query("WITH " + A.PAIR_SQL + """,
    f AS (SELECT t.task, min(t.line_no) FILTER (t.value = p.value) AS s, arg_min(t.input, t.line_no) FILTER (t.value = p.value) AS a, arg_min(t.input, t.line_no) FILTER (t.value IS DISTINCT FROM p.value) AS b FROM truth t LEFT JOIN pred p USING (task, line_no) WHERE task IN (SELECT task FROM pred) GROUP BY t.task)
    SELECT task, 'correct' AS status, a AS literal FROM f WHERE a IS NOT NULL UNION ALL SELECT task, 'error', b FROM f WHERE b IS NOT NULL""")
def first_case_inputs(spark, sf_dir):
    truth, pred = A.line_pair(spark, sf_dir)
    inputs = A.order_lines(spark, sf_dir, F.col("l_partkey").cast("string").alias("input")).select("task", "line_no", F.col("input").alias("value"))
    return sinks.first_case_columns(compare.first_cases(truth, pred, inputs, ["task"]))


@query("SELECT p_type, count(*) AS total, '[' || string_agg('{\"task_id\":' || p_partkey || ',\"p_size\":' || p_size || '}', ',' ORDER BY p_partkey) || ']' AS tasks FROM part GROUP BY p_type")
def json_reports(spark, sf_dir):
    rows = _part(spark, sf_dir, p_type="p_type", p_size="p_size").withColumnRenamed("p_partkey", "task_id")
    report = sinks.json_report(rows.groupBy("p_type").agg(F.count("*").alias("total")), rows, ["p_type"])
    return report.select("p_type", F.col("summary.total").alias("total"), F.to_json("tasks").alias("tasks"))


@query("WITH " + A.TRACE_SQL + " SELECT run, step, 'v' || (step % 3) AS var, value FROM trace WHERE step % 3 <> 2")
def kept_variables(spark, sf_dir):
    events = A.event_trace(spark, sf_dir).select("run", "step", F.element_at(F.array(F.lit("v0"), F.lit("v1"), F.lit("__file__")), F.col("step") % 3 + 1).alias("var"), "value", F.lit("value").alias("kind"))
    return sequence.traced(events).select("run", "step", "var", "value")
