"""Adapters: the driver's tables in the shapes that the operators read, on Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Lines of an order as result lines: task, line_no, value."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), number.alias("line_no"), F.concat("l_returnflag", "l_linestatus").alias("value"), *more)


LINES_SQL = """
    lines AS (
        SELECT l_orderkey AS task, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax))::INTEGER AS line_no,
            l_returnflag || l_linestatus AS value, l_partkey::VARCHAR AS input FROM lineitem
    )"""


def line_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth and prediction: order k + 1 predicts order k."""
    truth = order_lines(spark, sf_dir)
    return truth, truth.withColumn("task", F.col("task") - 1)


PAIR_SQL = LINES_SQL + """,
    truth AS (SELECT * FROM lines),
    pred AS (SELECT task - 1 AS task, line_no, value, input FROM lines)"""


def sentinel_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """line_pair() where a truth line is no case if the order before has the same on that line."""
    truth, pred = line_pair(spark, sf_dir)
    before = truth.select((F.col("task") + 1).alias("task"), "line_no", F.col("value").alias("before"))
    return truth.join(before, ["task", "line_no"], "left").withColumn("is_valid", ~F.col("value").eqNullSafe(F.col("before"))).drop("before"), pred


SENTINEL_SQL = LINES_SQL + """,
    truth AS (SELECT l.*, l.value IS DISTINCT FROM b.value AS is_valid FROM lines l LEFT JOIN (SELECT task + 1 AS task, line_no, value FROM lines) b USING (task, line_no)),
    pred AS (SELECT task - 1 AS task, line_no, value, input FROM lines)"""

#: Tally of truth (with is_valid) and pred, for the oracle.
TALLY_SQL = """,
    predicted AS (SELECT task, count(*) AS n_pred FROM pred GROUP BY task),
    known AS (SELECT task, count(*) AS n_truth FROM truth GROUP BY task),
    cases AS (SELECT t.task, t.line_no, p.task IS NULL AS missing, t.value IS NOT DISTINCT FROM p.value AND p.task IS NOT NULL AS same FROM truth t JOIN predicted USING (task) LEFT JOIN pred p USING (task, line_no) WHERE {valid}),
    counted AS (SELECT task, count(*) FILTER (same) AS same, count(*) AS total, count(*) FILTER (missing) AS missing, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (NOT same) AS diff FROM cases GROUP BY task),
    tally AS (
        SELECT task, CASE WHEN n_truth IS NULL THEN 'missing_file' WHEN coalesce(total, 0) = 0 THEN 'no_valid_cases' WHEN same = total THEN 'full_same' WHEN same = 0 THEN 'all_diff' ELSE 'partial_same' END AS status,
            coalesce(same, 0) AS same_count, coalesce(total, 0) AS total_count, coalesce(missing, 0) AS missing_lines,
            CASE WHEN n_truth IS NULL THEN 0 ELSE greatest(0, n_pred - n_truth) END AS extra_lines, coalesce(diff, '') AS diff_lines
        FROM predicted LEFT JOIN known USING (task) LEFT JOIN counted USING (task)
    )"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.functions import text

    return text.numbered_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")


DOC_LINES_SQL = """
    doc_lines AS (SELECT doc_id, i::INTEGER AS line_no, parts[i] AS value FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS parts FROM documents WHERE text <> '')))"""


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as steps: run, step, day, block and value."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), step.alias("step"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("block"), "value", "props")


TRACE_SQL = """
    trace AS (SELECT user_id AS run, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS step, ts::DATE AS day, event_type AS block, value, props FROM events)"""


def sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the collapsed blocks and their values, against those of the next user that day."""
    from traceloom.operators import sequence

    heads = sequence.changes(event_trace(spark, sf_dir), ["run", "day"], "step", "block")
    ordered = F.array_sort(F.collect_list(F.struct("step", "block", F.floor("value").cast("bigint").cast("string").alias("value"))))
    paths = heads.groupBy("run", "day").agg(ordered.alias("x")).select("run", "day", F.transform("x", lambda s: s["block"]).alias("path"), F.transform("x", lambda s: s["value"]).alias("vals"))
    other = paths.select((F.col("run") - 1).alias("run"), "day", F.col("path").alias("pred_path"), F.col("vals").alias("predicted_values"))
    return paths.withColumnsRenamed({"path": "truth_path", "vals": "truth_values"}).join(other, ["run", "day"]).withColumnRenamed("predicted_values", "pred_values")


SEQUENCES_SQL = TRACE_SQL + """,
    heads AS (SELECT * FROM (SELECT *, lag(block) OVER w AS before, row_number() OVER w AS n FROM trace WINDOW w AS (PARTITION BY run, day ORDER BY step)) WHERE n = 1 OR block IS DISTINCT FROM before),
    paths AS (SELECT run, day, list(block ORDER BY step) AS path, list(floor(value)::BIGINT::VARCHAR ORDER BY step) AS vals, string_agg(left(block, 1), '' ORDER BY step) AS code FROM heads GROUP BY run, day),
    pairs AS (SELECT a.run, a.day, a.path AS tp, b.path AS pp, a.vals AS tv, b.vals AS pv, a.code AS tc, b.code AS pc FROM paths a JOIN paths b ON b.run = a.run + 1 AND a.day = b.day),
    scored AS (
        SELECT *, levenshtein(tc, pc) AS distance, 1 - levenshtein(tc, pc)::DOUBLE / greatest(len(tp), len(pp)) AS block_similarity,
            len(list_filter(range(1, len(tv) + 1), lambda i: i <= len(pv) AND tv[i] = pv[i]))::DOUBLE / len(tv) AS value_accuracy,
            CASE WHEN tp = pp AND tv = pv THEN 'PERFECT' WHEN tp = pp THEN 'PATH_OK_VALUE_ERR'
                WHEN list_sort(list_distinct(tp)) = list_sort(list_distinct(pp)) AND len(tp) <> len(pp) THEN 'WRONG_ITER_COUNT'
                WHEN list_sort(list_distinct(tp)) = list_sort(list_distinct(pp)) THEN 'WRONG_ORDER'
                WHEN len(list_filter(pp, lambda x: NOT list_contains(tp, x))) > 0 THEN 'WRONG_BRANCH'
                WHEN len(pp) < len(tp) THEN 'EARLY_TERMINATION' ELSE 'MIXED_ERROR' END AS error_type,
            tp = pp AS path_exact, tv = pv AS values_exact, tv[len(tv)] = pv[len(pv)] AS final_correct, tv[len(tv)] = pv[len(pv)] AND tp <> pp AS reasoning_illusion
        FROM pairs
    )"""


#: Programs made of the sizes of parts: a helper, and a function with a loop and a branch. {n} is the size.
PROGRAM = "def helper(x, y=1):\n    return x * {n}\n\n\ndef fun1(n):\n    result = 0\n    for i in range(n):\n        if i % 2 == 0:\n            result += i\n        else:\n            result -= {n}\n    return result\n"
BROKEN = "def fun1(n:\n    return {n}\n"
ENDLESS = "def fun1(n):\n    while True:\n        n += {n}\n    return n\n"
#: A program of the shapes that the others lack: try, nested loops, elif, with, match, code after return, a method, an inner function, else of a loop.
SHAPES = "def outer(n):\n    try:\n        for i in range({n}):\n            for j in range(i):\n                if j > 2:\n                    return j\n                elif j == 1:\n                    continue\n    except ValueError:\n        n = 0\n    with open(n) as f:\n        n += {n}\n    match n:\n        case 1:\n            n = 2\n    return n\n    n = 3\n\n\nclass A:\n    def m(self):\n        def inner():\n            return 1\n        while self:\n            x = 1\n        else:\n            x = 2\n        if x:\n            x = {n}\n        return x\n"
TEST = "inputs = [[{n}], [3], [0]]\nresults = [1, 2, 0]\nassertion(fun1(3), 1, 0)"


def program_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of programs, one for each size of a part: every fifth doesn't parse, that of size 1 doesn't end."""
    filled = lambda template: F.replace(F.lit(template), F.lit("{n}"), F.col("n").cast("string"))
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).where("n IS NOT NULL").distinct()
    code = F.when(F.col("n") % 5 == 0, filled(BROKEN)).when(F.col("n") == 1, filled(ENDLESS)).otherwise(filled(PROGRAM))
    rows = sizes.select(F.concat(F.lit("task_"), F.col("n").cast("string")).alias("task_id"), code.alias("code"), filled(TEST).alias("test"), F.array(F.lit("assert helper(2) == 4"), F.lit("assert fun1(1) == 0")).alias("test_list"))
    changed = lambda a, b: F.replace(F.col("code"), F.lit(a), F.lit(b))
    return rows.select("*", changed("result += i", "result = result + i").alias("equivalent"), changed("result += i", "result += i + 1").alias("non_equivalent"), changed("    return result", "    return result +").alias("rejected"))


#: The same for the oracle: n, task_id and the kind of program.
TASKS_SQL = """
    tasks AS (SELECT DISTINCT p_size AS n, 'task_' || p_size AS task_id, CASE WHEN p_size % 5 = 0 THEN 'broken' WHEN p_size = 1 THEN 'endless' ELSE 'plain' END AS kind FROM part WHERE p_size IS NOT NULL)"""
