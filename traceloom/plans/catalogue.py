"""All queries of the engine that the driver can run, with oracle SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom import modes
from traceloom.functions import numbers, similarity, text
from traceloom.operators import compare, lineage, rollup, sequence
from traceloom.plans import adapters as A
from traceloom.plans import program_queries, text_queries
from traceloom.sources import files, folders, task_tree
from traceloom.streaming import reports

QUERIES: dict = program_queries.QUERIES | text_queries.QUERIES
ORACLES: dict = program_queries.ORACLES | text_queries.ORACLES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ALL_VALID, VALID = "true", "t.is_valid"
_TALLY = "WITH " + A.PAIR_SQL + A.TALLY_SQL.format(valid=ALL_VALID)
_SENTINEL = "WITH " + A.SENTINEL_SQL + A.TALLY_SQL.format(valid=VALID)
_BY_STATUS = " SELECT status, count(*) AS tasks, sum(same_count)::BIGINT AS same, sum(total_count)::BIGINT AS total, sum(missing_lines)::BIGINT AS missing, sum(extra_lines)::BIGINT AS extra FROM tally GROUP BY status"
_SUMMARY = """ SELECT count(*) AS task_count, count(*) FILTER (v) AS valid_task_count, coalesce(sum(same_count) FILTER (v), 0)::BIGINT AS same_cases, coalesce(sum(total_count) FILTER (v), 0)::BIGINT AS total_cases,
    count(*) FILTER (status = 'full_same') AS full_same_tasks, count(*) FILTER (status = 'partial_same') AS partial_same_tasks, count(*) FILTER (status = 'all_diff') AS all_diff_tasks,
    count(*) FILTER (status = 'missing_file') AS missing_file_tasks, count(*) FILTER (status = 'no_valid_cases') AS no_valid_case_tasks,
    coalesce(sum(missing_lines) FILTER (v), 0)::BIGINT AS missing_output_lines, coalesce(sum(extra_lines) FILTER (v), 0)::BIGINT AS extra_output_lines,
    coalesce(sum(same_count) FILTER (v)::DOUBLE / nullif(sum(total_count) FILTER (v), 0)::DOUBLE, 0.0) AS accuracy
    FROM (SELECT *, status NOT IN ('missing_file', 'no_valid_cases') AS v FROM tally)"""


def _tally(spark, sf_dir, sentinel=False):
    truth, pred = (A.sentinel_pair if sentinel else A.line_pair)(spark, sf_dir)
    return compare.compare_outputs(truth, pred, ["task"])


@query(_TALLY + _BY_STATUS)
def rq1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.status_totals(_tally(spark, sf_dir))


@query(_SENTINEL + _BY_STATUS)
def rq1_sentinel_summary(spark, sf_dir):
    return compare.status_totals(_tally(spark, sf_dir, sentinel=True))


@query(_TALLY + " SELECT * FROM tally")
def rq1_task_tally(spark, sf_dir):
    return _tally(spark, sf_dir).withColumn("diff_lines", F.array_join(F.col("diff_lines").cast("array<string>"), ","))


@query(_SENTINEL + _SUMMARY)
def rq1_accuracy(spark, sf_dir):
    tally = _tally(spark, sf_dir, sentinel=True).withColumn("mode", F.lit("original"))
    return compare.summarize(tally, ["mode"]).drop("mode")


@query("WITH " + A.PAIR_SQL + """
    , c AS (SELECT t.task, t.line_no, t.input, t.value IS NOT DISTINCT FROM p.value AND p.task IS NOT NULL AS same FROM truth t LEFT JOIN pred p USING (task, line_no)),
    f AS (SELECT task, min(line_no) FILTER (same) AS same_line, arg_min(input, line_no) FILTER (same) AS correct_input, min(line_no) FILTER (NOT same) AS diff_line, arg_min(input, line_no) FILTER (NOT same) AS error_input FROM c GROUP BY task)
    SELECT p.task, same_line, correct_input, diff_line, error_input FROM (SELECT DISTINCT task FROM pred) p LEFT JOIN f USING (task)""")
def first_same_first_diff(spark, sf_dir):
    truth, pred = A.line_pair(spark, sf_dir)
    inputs = A.order_lines(spark, sf_dir, F.col("l_partkey").cast("string").alias("input")).select("task", "line_no", F.col("input").alias("value"))
    return compare.first_cases(truth, pred, inputs, ["task"])


_HALVES = "WITH " + A.DOC_LINES_SQL + """,
    o AS (SELECT doc_id // 2 AS task, line_no, value FROM doc_lines WHERE doc_id % 2 = 0), m AS (SELECT doc_id // 2 AS task, line_no, value FROM doc_lines WHERE doc_id % 2 = 1),
    compared AS (SELECT task, line_no, coalesce(m.value, '') AS value, coalesce(o.value, '') <> coalesce(m.value, '') AS is_valid FROM o FULL JOIN m USING (task, line_no))"""


def _halves(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir).withColumn("task", F.expr("doc_id div 2"))
    return lines.where("doc_id % 2 = 0").drop("doc_id"), lines.where("doc_id % 2 = 1").drop("doc_id")


@query(_HALVES + " SELECT * FROM compared")
def compare_full_outer(spark, sf_dir):
    return compare.compare_lines(*_halves(spark, sf_dir), ["task"])


@query(_HALVES + """, t AS (SELECT task, count(*) FILTER (NOT is_valid) AS same, count(*) AS total FROM compared GROUP BY task)
    SELECT count(*) AS tasks, sum(same)::BIGINT AS same_cases, sum(total)::BIGINT AS total_cases, count(*) FILTER (same = total) AS fully_same_tasks, sum(same)::DOUBLE / sum(total)::DOUBLE AS same_ratio FROM t""")
def compare_totals(spark, sf_dir):
    return compare.compare_summary(compare.compare_lines(*_halves(spark, sf_dir), ["task"]), [], ["task"])


_THREE = "WITH " + A.PAIR_SQL + ", x AS (SELECT task, line_no, t.input, t.value AS original, p.value AS mutated FROM truth t FULL JOIN pred p USING (task, line_no))"


def _inputs(spark, sf_dir):
    return A.order_lines(spark, sf_dir, F.col("l_partkey").cast("string").alias("input")).select("task", "line_no", F.col("input").alias("value"))


@query(_THREE + " SELECT * FROM (SELECT task, (row_number() OVER (PARTITION BY task ORDER BY line_no))::INTEGER AS rank, line_no, input, original, mutated FROM x WHERE original IS DISTINCT FROM mutated) WHERE rank <= 3")
def diff_examples_top3(spark, sf_dir):
    truth, pred = A.line_pair(spark, sf_dir)
    return compare.examples(["task"], 3, truth, _inputs(spark, sf_dir), pred)


@query("WITH " + A.LINES_SQL + " SELECT * FROM (SELECT task, (row_number() OVER (PARTITION BY task ORDER BY line_no))::INTEGER AS rank, line_no, input, value AS original FROM lines) WHERE rank <= 3")
def match_examples_top3(spark, sf_dir):
    return compare.examples(["task"], 3, A.order_lines(spark, sf_dir), _inputs(spark, sf_dir))


_WHOLE = "WITH " + A.PAIR_SQL + """, o AS (SELECT task, string_agg(value, ',' ORDER BY line_no) AS o FROM truth GROUP BY task), m AS (SELECT task, string_agg(value, ',' ORDER BY line_no) AS m FROM pred GROUP BY task),
    v AS (SELECT task, CASE WHEN m IS NULL THEN 'missing_result' WHEN {passes} THEN 'passed' ELSE '{reason}' END AS reason FROM o LEFT JOIN m USING (task))"""


@query(_WHOLE.format(passes="o = m", reason="different_result") + " SELECT * FROM v")
def validate_equivalent(spark, sf_dir):
    return compare.validate(*A.line_pair(spark, sf_dir), ["task"], equivalent=True)


@query(_WHOLE.format(passes="o <> m", reason="same_result") + " SELECT * FROM v")
def validate_non_equivalent(spark, sf_dir):
    return compare.validate(*A.line_pair(spark, sf_dir), ["task"], equivalent=False)


@query("SELECT e.mode, e.total, e.passed, e.failed, e.missing FROM (" + _WHOLE.format(passes="o = m", reason="different_result") + " SELECT 'equivalent' AS mode, count(*) AS total, count(*) FILTER (reason = 'passed') AS passed, count(*) FILTER (reason <> 'passed') AS failed, count(*) FILTER (reason = 'missing_result') AS missing FROM v) e UNION ALL SELECT * FROM (" + _WHOLE.format(passes="o <> m", reason="same_result") + " SELECT 'non_equivalent', count(*), count(*) FILTER (reason = 'passed'), count(*) FILTER (reason <> 'passed'), count(*) FILTER (reason = 'missing_result') FROM v)")
def validation_report(spark, sf_dir):
    parts = [compare.validate(*A.line_pair(spark, sf_dir), ["task"], equivalent=e).withColumn("mode", F.lit("equivalent" if e else "non_equivalent")) for e in (True, False)]
    return compare.validation_summary(parts[0].unionByName(parts[1]), ["mode"])


@query(_WHOLE.format(passes="o = m", reason="different_result") + " SELECT task, reason FROM v WHERE reason NOT IN ('passed', 'missing_result')")
def validation_failures(spark, sf_dir):
    return compare.failures(compare.validate(*A.line_pair(spark, sf_dir), ["task"], equivalent=True))


@query("WITH " + A.PAIR_SQL + """, c AS (SELECT task, coalesce(t.value, '') <> coalesce(p.value, '') AS is_valid FROM truth t FULL JOIN pred p USING (task, line_no) WHERE task IN (SELECT task FROM truth)),
    l AS (SELECT task, bool_or(is_valid) AS v FROM c GROUP BY task), r AS (SELECT DISTINCT task, 1 AS ran FROM pred)
    SELECT task, problem FROM (SELECT o_orderkey AS task, CASE WHEN ran IS NULL THEN 'failed_or_timeout' WHEN v IS NULL THEN 'empty_compare' WHEN NOT v THEN 'fully_same' END AS problem FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN r ON r.task = o_orderkey LEFT JOIN l ON l.task = o_orderkey) WHERE problem IS NOT NULL""")
def problem_tasks(spark, sf_dir):
    truth, pred = A.line_pair(spark, sf_dir)
    compared = compare.compare_lines(truth, pred, ["task"]).join(truth.select("task").distinct(), "task", "left_semi")
    return compare.problem_tasks(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")), pred, compared, ["task"])


@query("WITH " + A.PAIR_SQL + """, n AS (SELECT task, count(*) AS n FROM truth GROUP BY task), k AS (SELECT task, count(*) AS n FROM pred GROUP BY task)
    SELECT task, count(*) FILTER (t.value = p.value) AS equal_lines, count(*) AS lines, count(*) FILTER (t.value = p.value) = count(*) AS fully_same FROM truth t JOIN pred p USING (task, line_no) JOIN n USING (task) JOIN k USING (task) WHERE n.n = k.n GROUP BY task""")
def equal_length_agreement(spark, sf_dir):
    return compare.agreement(*A.line_pair(spark, sf_dir), ["task"])


@query("SELECT o_orderkey AS task FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_tasks(spark, sf_dir):
    done = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"))
    return compare.missing_from(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")), done, ["task"])


@query("SELECT o_orderkey AS task, mode, status FROM orders, (VALUES ('original'), ('equivalent'), ('non_equivalent')) m(mode), (VALUES ('correct'), ('error')) s(status) WHERE NOT (mode = 'original' AND status = CASE o_orderstatus WHEN 'F' THEN 'correct' ELSE 'error' END)")
def resume_pending(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    done = orders.select(F.col("o_orderkey").alias("task"), F.lit("original").alias("mode"), F.when(F.col("o_orderstatus") == "F", "correct").otherwise("error").alias("status"))
    return compare.missing_from(modes.job_matrix(orders.select(F.col("o_orderkey").alias("task"))), done, ["task", "mode", "status"])


@query("WITH " + A.LINES_SQL + " SELECT o_orderkey AS task, CASE WHEN l.task IS NULL THEN 'missing' WHEN l.value = o_orderstatus || o_orderstatus THEN 'same' ELSE 'diff' END AS verdict FROM orders LEFT JOIN (SELECT * FROM lines WHERE line_no = 1) l ON l.task = o_orderkey")
def input_audit(spark, sf_dir):
    first = A.order_lines(spark, sf_dir).where("line_no = 1")
    wanted = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.concat("o_orderstatus", "o_orderstatus").alias("value"))
    return compare.audit(first, wanted, ["task"], "value")


@query("WITH " + A.DOC_LINES_SQL + " SELECT doc_id FROM doc_lines GROUP BY doc_id HAVING count(*) = 1")
def single_line_files(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")


@query("""SELECT 'page' AS kind, page_id AS id, CASE WHEN h IS NULL OR h = '' THEN 'ERROR: empty' WHEN regexp_matches(h, '(?s)<result>(.*?)</result>') THEN trim(regexp_extract(h, '(?s)<result>(.*?)</result>', 1), e' \\t\\n\\r\\f\\v') ELSE trim(h, e' \\t\\n\\r\\f\\v') END AS result
    FROM (SELECT page_id, replace(replace(html, '<title>', '<result>'), '</title>', '</result>') AS h FROM pages)
    UNION ALL SELECT 'document', doc_id, CASE WHEN text IS NULL OR text = '' THEN 'ERROR: empty' ELSE trim(text, e' \\t\\n\\r\\f\\v') END FROM documents""")
def result_block_extract(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.replace(F.replace("html", F.lit("<title>"), F.lit("<result>")), F.lit("</title>"), F.lit("</result>")).alias("raw"))
    docs = A.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return pages.unionByName(docs).select("kind", "id", text.result_block(F.col("raw")).alias("result"))


@query("WITH " + A.TRACE_SQL + " SELECT run, block AS var, arg_max(props, step) AS value, max(step) AS line_no FROM trace GROUP BY run, block")
def kv_parse_last_wins(spark, sf_dir):
    lines = A.event_trace(spark, sf_dir).select("run", F.col("step").alias("line_no"), F.concat(F.lit(" '"), "block", F.lit("': "), "props").alias("value"))
    return text.key_values(lines, ["run"])


@query("WITH " + A.DOC_LINES_SQL + """, v AS (SELECT doc_id, line_no, lower(value) AS value FROM doc_lines)
    SELECT doc_id, line_no, value, CASE WHEN starts_with(value, 'for') THEN 'loop' ELSE 'plain' END AS kind, CASE WHEN starts_with(value, 'for') THEN 'result = []' || chr(10) || 'for inp in inputs:' ELSE value END AS routed FROM v""")
def line_router(spark, sf_dir):
    return text.routed_lines(A.doc_lines(spark, sf_dir).withColumn("value", F.lower("value")), ["doc_id"])


@query("""SELECT doc_id, 'B' || (doc_id % 17) || ',B' || (doc_id % 5) AS items, 2 AS n FROM documents""")
def token_normalise(spark, sf_dir):
    raw = F.concat(F.lit("[B"), F.col("doc_id") % 17, F.lit(', "B'), F.col("doc_id") % 5, F.lit('"]'))
    return A.table(spark, sf_dir, "documents").select("doc_id", text.list_items(raw).alias("x")).select("doc_id", F.array_join("x", ",").alias("items"), F.size("x").alias("n"))


@query("WITH " + A.DOC_LINES_SQL + """, one AS (SELECT doc_id, any_value(value) AS value FROM doc_lines GROUP BY doc_id HAVING count(*) = 1)
    SELECT doc_id, len(list_filter(regexp_split_to_array(value, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::INTEGER AS n_items FROM one""")
def single_line_split(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where(F.size(text.file_lines(F.col("text"))) == 1)
    return docs.select("doc_id", F.size(text.split_items(F.col("text"))).alias("n_items"))


_CHANGES = ", n AS (SELECT *, lag({v}) OVER w AS before, row_number() OVER w AS i FROM trace WINDOW w AS (PARTITION BY {by} ORDER BY step)), c AS (SELECT * FROM n WHERE i = 1 OR {v} IS DISTINCT FROM before)"


@query("WITH " + A.TRACE_SQL + _CHANGES.format(v="floor(value / 40)", by="run, block") + " SELECT run, block AS var, count(*) AS n_changes, string_agg(floor(value / 40)::BIGINT::VARCHAR, ',' ORDER BY step) AS sequence FROM c WHERE NOT starts_with(block, '__') GROUP BY run, block")
def variable_change_seq(spark, sf_dir):
    events = sequence.traced(A.event_trace(spark, sf_dir).withColumnRenamed("block", "var").withColumn("v", F.floor(F.col("value") / 40).cast("string")))
    new = sequence.changes(events, ["run", "var"], "step", "v")
    seqs = sequence.collected(new, ["run", "var"], "step", "v", "s")
    return seqs.select("run", "var", F.size("s").cast("bigint").alias("n_changes"), F.array_join("s", ",").alias("sequence"))


@query("WITH " + A.TRACE_SQL + _CHANGES.format(v="floor(value / 40)", by="run, day, block") + " SELECT run, day, step, count(*) AS n_changed, string_agg(block || '=' || floor(value / 40)::BIGINT, ',' ORDER BY block) AS changed FROM c GROUP BY run, day, step")
def frame_change_seq(spark, sf_dir):
    events = A.event_trace(spark, sf_dir).select("run", "day", "step", F.col("block").alias("var"), F.floor(F.col("value") / 40).cast("string").alias("value"))
    found = sequence.deltas(events, ["run", "day"], "step")
    pairs = F.array_sort(F.transform(F.map_entries("changes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("run", "day", "step", F.size("changes").cast("bigint").alias("n_changed"), F.array_join(pairs, ",").alias("changed"))


_RUNS = "WITH " + A.TRACE_SQL + _CHANGES.format(v="block", by="run") + ", p AS (SELECT run, step, block, value, row_number() OVER (PARTITION BY run ORDER BY step) AS path_no FROM c)"


@query(_RUNS + " SELECT run, path_no::INTEGER AS path_no, CASE WHEN path_no <= 20 THEN block ELSE 'TRUNCATED' END AS block FROM p WHERE path_no <= 21")
def block_sequence(spark, sf_dir):
    steps = sequence.block_steps(A.event_trace(spark, sf_dir), ["run"], "step", "block")
    return sequence.capped(steps, ["run"], "block", cap=20).select("run", "path_no", "block")


@query(_RUNS + ", f AS (SELECT *, floor(value / 100) AS v FROM p WHERE path_no <= 20), d AS (SELECT *, lag(v) OVER w AS b, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY run ORDER BY path_no)) SELECT run, path_no::INTEGER AS path_no, v::BIGINT AS v FROM d WHERE i = 1 OR v IS DISTINCT FROM b")
def value_dedupe_on_block(spark, sf_dir):
    steps = sequence.block_steps(A.event_trace(spark, sf_dir), ["run"], "step", "block").where("path_no <= 20").withColumn("v", F.floor(F.col("value") / 100).cast("bigint"))
    return sequence.value_steps(steps, ["run"], "v").select("run", "path_no", "v")


@query(_RUNS + ", f AS (SELECT *, floor(value / 100)::BIGINT AS v FROM p), d AS (SELECT *, lag(v) OVER w AS b, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY run ORDER BY path_no)) SELECT run, string_agg(CASE WHEN path_no <= 20 THEN block ELSE 'TRUNCATED' END, ',' ORDER BY path_no) FILTER (path_no <= 21) AS path, string_agg(v::VARCHAR, ',' ORDER BY path_no) FILTER (path_no <= 20 AND (i = 1 OR v IS DISTINCT FROM b)) AS vals, string_agg(block || ':' || v, ',' ORDER BY path_no) FILTER (path_no <= 20) AS paired FROM d GROUP BY run")
def block_trace_output(spark, sf_dir):
    events = A.event_trace(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 100).cast("bigint"))
    found = sequence.block_traces(events, ["run"], "step", "block", "v", cap=20)
    return found.select("run", F.array_join("block_sequence", ",").alias("path"), F.array_join("values", ",").alias("vals"), F.array_join(F.transform("paired", lambda p: F.concat(p["block"], F.lit(":"), p["value"])), ",").alias("paired"))


@query("SELECT p_partkey, p_size, 'B' || (p_size // 7) AS block_id FROM part")
def line_to_block_map(spark, sf_dir):
    spans = spark.range(0, 10).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("block_id"), (F.col("id") * 7).alias("low"), (F.col("id") * 7 + 6).alias("high"))
    return sequence.range_blocks(A.table(spark, sf_dir, "part").select("p_partkey", "p_size"), spans, "p_size", "low", "high", 16).select("p_partkey", "p_size", "block_id")


@query("WITH " + A.TRACE_SQL + " SELECT run, step, block, value, 'B' || (step % 4) AS block_id FROM trace WHERE step % 4 <> 3")
def line_block_join(spark, sf_dir):
    events = A.event_trace(spark, sf_dir).select("run", "step", "block", "value", (F.col("step") % 4).alias("line_no"))
    lines = events.select("run").distinct().select("run", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("line_no")).withColumn("block_id", F.concat(F.lit("B"), F.col("line_no").cast("string")))
    return sequence.line_blocks(events, lines, ["run"]).drop("line_no")


_SCORED = "WITH " + A.SEQUENCES_SQL


def _scored(spark, sf_dir):
    return similarity.score_pairs(A.sequence_pairs(spark, sf_dir))


@query(_SCORED + " SELECT run, day, distance::INTEGER AS distance, block_similarity FROM scored")
def edit_distance_pairs(spark, sf_dir):
    return _scored(spark, sf_dir).select("run", "day", "distance", "block_similarity")


@query(_SCORED + " SELECT run, day, value_accuracy FROM scored")
def value_accuracy(spark, sf_dir):
    return _scored(spark, sf_dir).select("run", "day", "value_accuracy")


@query(_SCORED + " SELECT error_type, count(*) AS n FROM scored GROUP BY error_type")
def error_class_distribution(spark, sf_dir):
    return rollup.error_distribution(_scored(spark, sf_dir))


@query(_SCORED + " SELECT run, day, path_exact, values_exact, final_correct, reasoning_illusion FROM scored")
def reasoning_illusion(spark, sf_dir):
    return _scored(spark, sf_dir).select("run", "day", "path_exact", "values_exact", "final_correct", "reasoning_illusion")


@query(_SCORED + """ SELECT coalesce(dayname(day), 'total') AS label, count(*) AS files, round(avg(block_similarity), 9) AS avg_similarity, round(avg(value_accuracy), 9) AS avg_value_accuracy, count(*) FILTER (path_exact) AS path_exact, count(*) FILTER (values_exact) AS values_exact,
    count(*) FILTER (final_correct) AS final_correct, count(*) FILTER (reasoning_illusion) AS reasoning_illusions FROM scored GROUP BY ROLLUP (dayname(day))""")
def block_trace_rollup(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(x) for x in "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()]), F.dayofweek("day"))
    found = rollup.block_rollup(_scored(spark, sf_dir).withColumn("label", names), "label")
    return found.withColumns({c: F.round(c, 9) for c in ("avg_similarity", "avg_value_accuracy")})


_VARS = "WITH " + A.TRACE_SQL + """, last AS (SELECT run, block AS var, (arg_max(value, step)::INTEGER // 50) AS value FROM trace GROUP BY run, block),
    n AS (SELECT run, count(*) AS n FROM last GROUP BY run),
    j AS (SELECT a.run, a.var, a.value = b.value AS same FROM last a JOIN last b ON b.run = a.run + 1 AND a.var = b.var),
    s AS (SELECT x.run, x.n AS nt, y.n AS np, count(*) FILTER (j.same) AS m, count(*) FILTER (j.var = 'click') AS r, count(*) FILTER (j.same AND j.var = 'click') AS rm FROM n x JOIN n y ON y.run = x.run + 1 LEFT JOIN j ON j.run = x.run GROUP BY x.run, x.n, y.n),
    scores AS (SELECT run, r = 0 AS skipped, CASE WHEN r = 0 THEN 0 ELSE least(nt, np) END AS vars_compared, CASE WHEN r = 0 THEN 0 ELSE m END AS vars_matched, r > 0 AND rm > 0 AS result_match, r > 0 AND m = least(nt, np) AS all_match FROM s)"""


def _variables(spark, sf_dir):
    last = A.event_trace(spark, sf_dir).groupBy("run", F.col("block").alias("var")).agg(F.max_by("value", "step").alias("v"))
    # rounds half to even, as the oracle's cast does
    last = last.select("run", "var", F.expr("cast(bround(v) AS int) div 50").cast("string").alias("value"))
    return rollup.variable_scores(last, last.withColumn("run", F.col("run") - 1), ["run"], result="click")


@query(_VARS + " SELECT * FROM scores")
def trace_var_match(spark, sf_dir):
    return _variables(spark, sf_dir)


@query(_VARS + """ SELECT coalesce((run % 3)::VARCHAR, 'total') AS label, count(*) FILTER (NOT skipped) AS valid_files, count(*) FILTER (skipped) AS skipped_files, count(*) FILTER (result_match) AS result_matches, count(*) FILTER (all_match) AS all_matches,
    sum(vars_matched)::BIGINT AS vars_matched, sum(vars_compared)::BIGINT AS vars_compared, count(*) FILTER (result_match)::DOUBLE / nullif(count(*) FILTER (NOT skipped), 0) AS result_rate, count(*) FILTER (all_match)::DOUBLE / nullif(count(*) FILTER (NOT skipped), 0) AS all_rate,
    sum(vars_matched)::DOUBLE / nullif(sum(vars_compared), 0)::DOUBLE AS variable_rate FROM scores GROUP BY ROLLUP (run % 3)""")
def trace_rollup(spark, sf_dir):
    return rollup.variable_rollup(_variables(spark, sf_dir).withColumn("third", F.col("run") % 3), "third")


@query("SELECT o_orderpriority AS stage, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS timeout, count(*) AS total FROM orders GROUP BY o_orderpriority")
def exec_status_pivot(spark, sf_dir):
    names = F.create_map(F.lit("F"), F.lit("success"), F.lit("O"), F.lit("failed"), F.lit("P"), F.lit("timeout"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.try_element_at(names, F.col("o_orderstatus")).alias("status"))
    return rollup.status_pivot(rows, ["stage"], "status", ["success", "failed", "timeout"])


@query("SELECT o_orderpriority AS stage, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def stage_counters(spark, sf_dir):
    return rollup.status_counts(A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")), ["stage"])


@query("SELECT o_orderkey AS task, mode, status FROM orders, (VALUES ('original'), ('equivalent'), ('non_equivalent')) m(mode), (VALUES ('correct'), ('error')) s(status)")
def mode_matrix(spark, sf_dir):
    return modes.job_matrix(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")))


@query("SELECT source, doc_id, sample_rank FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY sha256('13:' || source || ':' || doc_id), doc_id))::INTEGER AS sample_rank FROM documents) WHERE sample_rank <= 5")
def deterministic_sample(spark, sf_dir):
    return sequence.sampled(A.table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 5, 13).select("source", "doc_id", "sample_rank")


_TOP = "SELECT * FROM (SELECT '{name}' AS ordering, (row_number() OVER (ORDER BY {by}))::INTEGER AS rank, task_id FROM (SELECT doc_id, 'task_' || doc_id AS task_id FROM documents)) WHERE rank <= 100"


@query(_TOP.format(name="number", by="doc_id") + " UNION ALL " + _TOP.format(name="text", by="task_id"))
def numeric_task_order_topk(spark, sf_dir):
    """The first 100 tasks by number and by text: two limits after sorts, ranked within what they keep."""
    rows = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("task_"), F.col("doc_id").cast("string")).alias("task_id"))
    out = None
    for name, order in (("number", text.task_number(F.col("task_id"))), ("text", F.col("task_id"))):
        top = rows.orderBy(order, "task_id").limit(100)
        part = top.select(F.lit(name).alias("ordering"), F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order, "task_id")).alias("rank"), "task_id")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT conv_id::VARCHAR AS task_id, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'fixed' ELSE 'failed' END AS status, count(*) AS attempts, min(turn) FILTER (role = 'assistant')::INTEGER AS accepted_at, array_to_string(list_sort(list(DISTINCT role)), ',') AS reasons, count(*) FILTER (role = 'assistant') > 0 AS fixed FROM conversations GROUP BY conv_id")
def audit_explode(spark, sf_dir):
    tries = F.struct(F.col("turn").cast("int").alias("attempt"), (F.col("role") == "assistant").alias("ok"), F.col("role").alias("reason"))
    results = A.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("task_id")).agg(F.array_sort(F.collect_list(tries)).alias("attempts"))
    results = results.withColumn("status", F.when(F.exists("attempts", lambda a: a["ok"]), "fixed").otherwise("failed"))
    return rollup.repair_outcomes(results).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT doc_id, sha256(text) AS code_hash FROM documents")
def code_hash(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.code_hash(F.col("text")).alias("code_hash"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_agreement(spark, sf_dir):
    return A.table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("WITH " + A.TRACE_SQL + " SELECT run, block AS var, count(*) AS n_writes, arg_max(value, step) AS final_value FROM trace GROUP BY run, block")
def write_accumulation(spark, sf_dir):
    found = sequence.writes(A.event_trace(spark, sf_dir), ["run"], "step", "block", "value")
    return found.select("run", F.col("block").alias("var"), F.size("values").cast("bigint").alias("n_writes"), sequence.final_value(F.col("values")).alias("final_value"))


@query("SELECT CASE WHEN t IS NULL THEN 'two_labels' ELSE t END AS source, count(*) AS n FROM (SELECT DISTINCT conv_id, 'conversation' AS t FROM conversations UNION SELECT DISTINCT doc_id, 'label' FROM labels) GROUP BY ALL")
def union_distinct_ids(spark, sf_dir):
    one = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("conversation").alias("source"))
    two = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("source"))
    return one.union(two).distinct().groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS id FROM conversations INTERSECT SELECT doc_id FROM labels")
def intersect_ids(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).intersect(A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("WITH " + A.TRACE_SQL + " SELECT error_type, sum(n)::BIGINT AS n FROM (SELECT block AS error_type, count(*) AS n FROM trace WHERE run % 2 = 0 GROUP BY block UNION ALL SELECT block, count(*) FROM trace WHERE run % 2 = 1 GROUP BY block) GROUP BY error_type")
def distribution_merge(spark, sf_dir):
    events = A.event_trace(spark, sf_dir).withColumnRenamed("block", "error_type")
    return rollup.merged_distributions(rollup.error_distribution(events.where("run % 2 = 0")), rollup.error_distribution(events.where("run % 2 = 1")))


#: A small graph of stages over the parts, four levels deep: one result of each stage for each part, and a report of all.
_STAGES = {"code": [], "inputs": [], "graph": ["code"], "run": ["code", "inputs"], "compare": ["run"], "trace": ["code", "compare"], "scores": ["trace"], "report": ["scores"]}
_EDGES = ", ".join(f"('{s}', '{n}')" for s, needs in _STAGES.items() for n in needs)


@query(f"""WITH RECURSIVE edges(stage, needs) AS (VALUES {_EDGES}),
    changed AS (SELECT p_partkey, 'code' AS stage FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 'inputs' FROM part WHERE p_size % 11 = 0),
    built AS (SELECT p_partkey, stage FROM changed UNION SELECT b.p_partkey, e.stage FROM built b JOIN edges e ON e.needs = b.stage)
    SELECT DISTINCT CASE WHEN stage <> 'report' THEN p_partkey END AS p_partkey, stage FROM built WHERE stage NOT IN ('code', 'inputs')""")
def stale_results(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part").where("p_partkey IS NOT NULL")
    rows = lambda code, inputs: {s: parts.select("p_partkey", (code if s == "code" else inputs if s == "inputs" else F.concat_ws(" of ", F.lit(s), "p_name")).alias("value")) for s in _STAGES if s != "report"}
    before = rows(F.col("p_name"), F.col("p_size").cast("string"))
    after = rows(F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), F.when(F.col("p_size") % 11 == 0, "0").otherwise(F.col("p_size").cast("string")))
    records = lineage.input_hashes(lineage.all_contents(before, "p_partkey"), _STAGES, "p_partkey")
    return lineage.stale(lineage.changed(lineage.all_contents(after, "p_partkey"), records, _STAGES, "p_partkey"), _STAGES, "p_partkey")


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def incremental_latest_orders(spark, sf_dir):
    columns = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"]
    orders = A.table(spark, sf_dir, "orders")
    at = f"{folders.scratch(spark)}/report-{uuid.uuid4().hex}"
    # a pattern, since a stream's path may be a folder or a pattern but no single file
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/orders.parque[t]")
    reports.incremental_report(stream.select(*columns), f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return reports.report(spark, f"{at}/rows", orders.select(*columns).schema, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""SELECT p_partkey, places, (q + CASE WHEN 2 * r > 64 OR (2 * r = 64 AND q % 2 = 1) THEN 1 ELSE 0 END) / (10.0 ** places)::DOUBLE AS rounded
    FROM (SELECT p_partkey, places, (p_partkey * (10 ** places)::BIGINT) // 64 AS q, (p_partkey * (10 ** places)::BIGINT) % 64 AS r FROM part, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS places))""")
def python_rounding(spark, sf_dir):
    values = A.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") / 64.0).alias("x"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("places"), numbers.rounded(F.col("x"), n).alias("rounded")) for n in range(6)]))
    return values.select("p_partkey", each.alias("r")).select("p_partkey", "r.*")


@query("""WITH spans AS (SELECT p_size % 3 AS run, p_partkey AS block_id, (p_partkey // (1 << (p_size % 9))) * (1 << (p_size % 9)) AS low, (p_partkey // (1 << (p_size % 9)) + 1) * (1 << (p_size % 9)) - 1 AS high FROM part WHERE p_partkey % 4 = 0),
    events AS (SELECT p_partkey % 3 AS run, p_partkey AS step FROM part)
    SELECT run, step, arg_max(block_id, (low - high, block_id)) AS block FROM events JOIN spans USING (run) WHERE step BETWEEN low AND high GROUP BY run, step""")
def innermost_blocks(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part")
    width = "cast(shiftleft(1, p_size % 9) AS bigint)"
    spans = parts.where("p_partkey % 4 = 0").selectExpr("p_size % 3 AS run", "p_partkey AS block_id", f"(p_partkey div {width}) * {width} AS low", f"(p_partkey div {width} + 1) * {width} - 1 AS high")
    events = parts.selectExpr("cast(p_partkey % 3 AS int) AS run", "p_partkey AS step")
    return sequence.innermost(events, spans.withColumn("run", F.col("run").cast("int")), ["run"], "step", "low", "high", "block_id").withColumnRenamed("innermost", "block")


def _supplier_tree(spark, sf_dir, text, name):
    """A task tree of the suppliers' files, a file each."""
    at = f"{folders.scratch(spark)}/tree-{uuid.uuid4().hex}"
    rows = A.table(spark, sf_dir, "supplier").where("s_suppkey IS NOT NULL")
    task_tree.write_task_files(rows.select(F.concat(F.lit("task_"), F.col("s_suppkey").cast("string")).alias("task_id"), text.alias("text")), at, name)
    return at


@query("""SELECT 'task_' || s_suppkey AS task_id, 1 AS line_no, '[' || s_nationkey || ']' AS literal FROM supplier UNION ALL SELECT 'task_' || s_suppkey, 2, '[' || s_suppkey || ', 1]' FROM supplier""")
def tree_input_literals(spark, sf_dir):
    at = _supplier_tree(spark, sf_dir, F.expr("concat('[', s_nationkey, ']\\n\\n  [', s_suppkey, ', 1]\\t\\n')"), "{task_id}/inputs.txt")
    return files.input_literals(spark, at, "inputs.txt")


@query("""SELECT 'task_' || s_suppkey AS task_id, 'result/out.txt' AS file, length('x' || s_name) AS size, 'x' || s_name AS text FROM supplier ORDER BY s_suppkey LIMIT 12""")
def tree_numeric_order_limit(spark, sf_dir):
    at = _supplier_tree(spark, sf_dir, F.concat(F.lit("x"), "s_name"), "{task_id}/result/out.txt")
    return task_tree.task_files(spark, at, "*.txt", order="number", limit="12")


@query("""SELECT 'task_' || s_suppkey AS task_id, s_nationkey::INTEGER AS nation, s_name AS name, [s_suppkey::INTEGER, 2][1] AS first FROM supplier""")
def tree_json_documents(spark, sf_dir):
    doc = F.to_json(F.struct(F.concat(F.lit("task_"), F.col("s_suppkey").cast("string")).alias("task_id"), F.col("s_nationkey").cast("int").alias("nation"), F.struct("s_name", F.array(F.col("s_suppkey").cast("int"), F.lit(2)).alias("items")).alias("held")))
    at = _supplier_tree(spark, sf_dir, doc, "{task_id}.json")
    rows = files.json_documents(spark, at, "task_id string, nation int, held struct<s_name:string,items:array<int>>")
    return rows.select("task_id", "nation", F.col("held.s_name").alias("name"), F.col("held.items")[0].alias("first"))
