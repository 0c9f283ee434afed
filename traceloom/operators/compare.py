"""Line-by-line comparison of predicted, observed and original outputs.

Line tables have key columns, line_no (from 1) and value; truth may have is_valid. Each operator keeps the null rule of
its own kind of missing line: a line that a prediction lacks is a null (and differs), one that an output lacks in the
compare sink is an empty text, and in the validators' examples a null that equals a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(keys: list[str], **sides: DataFrame) -> DataFrame:
    """One row per key and line that any side has: has_<side>, <side> and <side>_valid.

    Full outer joins, as each side has a line once: both sides are shuffled and sorted once, which an aggregate of texts
    over their union would do twice. Keys are not null.
    """
    out = None
    for name, lines in sides.items():
        valid = F.col("is_valid") if "is_valid" in lines.columns else F.lit(True)
        part = lines.select(*keys, F.col("line_no").cast("int").alias("line_no"), F.lit(True).alias(f"has_{name}"), F.col("value").cast("string").alias(name), valid.alias(f"{name}_valid"))
        out = part if out is None else out.join(part, [*keys, "line_no"], "full")
    return out.withColumns({f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in sides})


def status_of(same: Column, total: Column) -> Column:
    return F.when(total == 0, "no_valid_cases").when(same == total, "full_same").when(same == 0, "all_diff").otherwise("partial_same")


def compare_outputs(truth: DataFrame, predicted: DataFrame, keys: list[str], truth_tasks: DataFrame | None = None, include_unpredicted: bool = False) -> DataFrame:
    """Tally of each predicted task: status, same_count, total_count, missing_lines, extra_lines, diff_lines.

    Truth lines whose is_valid is false are no cases. Predicted lines beyond the truth are counted only. A task without
    truth is a missing_file (with truth_tasks, the keys whose truth and input files exist, an empty file is no missing one
    and a missing input file counts). Tasks
    without a prediction are left out, unless include_unpredicted.
    """
    lines = aligned(keys, truth=truth, pred=predicted)
    case = F.col("has_truth") & F.coalesce(F.col("truth_valid"), F.lit(True))
    same = case & F.col("has_pred") & F.col("truth").eqNullSafe(F.col("pred"))
    tally = lines.groupBy(*keys).agg(
        F.count_if(same).alias("same_count"),
        F.count_if(case).alias("total_count"),
        F.count_if(case & ~F.col("has_pred")).alias("missing_lines"),
        F.greatest(F.lit(0), F.count_if("has_pred") - F.count_if("has_truth")).alias("extra_lines"),
        F.array_sort(F.collect_list(F.when(case & ~same, F.col("line_no")))).alias("diff_lines"),
        F.count_if("has_truth").alias("n_truth"),
        F.count_if("has_pred").alias("n_pred"),
    )
    known = F.col("n_truth") > 0
    if truth_tasks is not None:
        tally = tally.join(truth_tasks.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
        known = F.col("_known").isNotNull()
    if not include_unpredicted:
        tally = tally.where("n_pred > 0")
    gone = ~known
    zero = lambda c: F.when(gone, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c)
    status = F.when(gone, "missing_file").otherwise(status_of(F.col("same_count"), F.col("total_count"))).alias("status")
    return tally.select(*keys, status, zero("same_count"), zero("total_count"), zero("missing_lines"), zero("extra_lines"), F.when(gone, F.array().cast("array<int>")).otherwise(F.col("diff_lines")).alias("diff_lines"))


def summarize(tally: DataFrame, by: list[str]) -> DataFrame:
    """Roll-up of compare_outputs(): counts of tasks by status, sums over valid tasks, accuracy (0 without cases)."""
    valid = ~F.col("status").isin("missing_file", "no_valid_cases")
    total = lambda c: F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).cast("bigint")
    count = lambda s: F.count_if(F.col("status") == s)
    out = tally.groupBy(*by).agg(
        F.count("*").alias("task_count"),
        F.count_if(valid).alias("valid_task_count"),
        total("same_count").alias("same_cases"),
        total("total_count").alias("total_cases"),
        count("full_same").alias("full_same_tasks"),
        count("partial_same").alias("partial_same_tasks"),
        count("all_diff").alias("all_diff_tasks"),
        count("missing_file").alias("missing_file_tasks"),
        count("no_valid_cases").alias("no_valid_case_tasks"),
        total("missing_lines").alias("missing_output_lines"),
        total("extra_lines").alias("extra_output_lines"),
    )
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("same_cases"), F.col("total_cases")), F.lit(0.0)))


def status_totals(tally: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tasks and line sums by status."""
    return tally.groupBy(*(by or []), "status").agg(F.count("*").alias("tasks"), F.sum("same_count").alias("same"), F.sum("total_count").alias("total"), F.sum("missing_lines").alias("missing"), F.sum("extra_lines").alias("extra"))


def first_cases(truth: DataFrame, predicted: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each predicted task the input of the first line that is the same and of the first that differs; "" if it lacks that line."""
    lines = aligned(keys, truth=truth, pred=predicted, input=inputs)
    case = F.col("has_truth") & F.coalesce(F.col("truth_valid"), F.lit(True))
    same = F.col("has_pred") & F.col("truth").eqNullSafe(F.col("pred"))
    least = lambda cond: F.min(F.when(case & cond, F.struct("line_no", F.coalesce("input", F.lit("")).alias("input"))))
    found = lines.groupBy(*keys).agg(F.count_if("has_pred").alias("n_pred"), least(same).alias("s"), least(~same).alias("d")).where("n_pred > 0")
    return found.select(*keys, F.col("s.line_no").alias("same_line"), F.col("s.input").alias("correct_input"), F.col("d.line_no").alias("diff_line"), F.col("d.input").alias("error_input"))


def compare_lines(original: DataFrame, mutant: DataFrame, keys: list[str]) -> DataFrame:
    """Compare sink: of each line of either side the mutant's text, and whether it is a valid case (differs). Missing lines are ""."""
    lines = aligned(keys, orig=original, mut=mutant)
    o, m = F.coalesce("orig", F.lit("")), F.coalesce("mut", F.lit(""))
    return lines.select(*keys, "line_no", m.alias("value"), (o != m).alias("is_valid"))


def compare_summary(lines: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Same and all cases, tasks whose lines are all the same, and their ratio, of compare_lines()."""
    tasks = lines.groupBy(*keys).agg(F.count_if(~F.col("is_valid")).alias("same"), F.count("*").alias("total"))
    out = tasks.groupBy(*by).agg(F.count("*").alias("tasks"), F.sum("same").alias("same_cases"), F.sum("total").alias("total_cases"), F.count_if((F.col("same") == F.col("total")) & (F.col("total") > 0)).alias("fully_same_tasks"))
    return out.withColumn("same_ratio", F.coalesce(F.try_divide("same_cases", "total_cases"), F.lit(0.0)))


def examples(keys: list[str], k: int, original: DataFrame, inputs: DataFrame, mutant: DataFrame | None = None) -> DataFrame:
    """The first k lines of each task: with a mutant those that differ from it (null-safe), else all; with originals and inputs."""
    sides = {"original": original, "input": inputs} | ({"mutated": mutant} if mutant is not None else {})
    lines = aligned(keys, **sides)
    if mutant is not None:
        lines = lines.where(~F.col("original").eqNullSafe(F.col("mutated")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
    return lines.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "line_no", "input", *[c for c in ("original", "mutated") if c in sides])


def validate(original: DataFrame, mutant: DataFrame, keys: list[str], equivalent: bool) -> DataFrame:
    """A verdict for each task of the original: passed, different_result / same_result, or missing_result.

    An equivalent mutant passes with the same lines, a non-equivalent one with different lines. Lines are counted, not
    gathered, so a task of any length is compared.
    """
    lines = aligned(keys, orig=original, mut=mutant)
    both = F.col("has_orig") & F.col("has_mut") & F.col("orig").eqNullSafe(F.col("mut"))
    tasks = lines.groupBy(*keys).agg(F.count_if("has_orig").alias("n_orig"), F.count_if("has_mut").alias("n_mut"), F.count_if(~both).alias("n_differ")).where("n_orig > 0")
    same = F.col("n_differ") == 0
    reason = F.when(F.col("n_mut") == 0, "missing_result").when(same if equivalent else ~same, "passed").otherwise("different_result" if equivalent else "same_result")
    return tasks.select(*keys, reason.alias("reason"))


def validation_summary(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """total, passed, failed and missing; a missing result counts as failed too."""
    return verdicts.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "passed").alias("passed"), F.count_if(F.col("reason") != "passed").alias("failed"), F.count_if(F.col("reason") == "missing_result").alias("missing"))


def failures(verdicts: DataFrame, include_missing: bool = False) -> DataFrame:
    bad = F.col("reason") != "passed"
    return verdicts.where(bad if include_missing else bad & (F.col("reason") != "missing_result"))


def problem_tasks(tasks: DataFrame, results: DataFrame, compared: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks with a problem and its exclusive kind: failed_or_timeout (no result), empty_compare, or fully_same (no valid line)."""
    has = results.select(*keys).distinct().withColumn("ran", F.lit(True))
    lines = compared.groupBy(*keys).agg(F.bool_or("is_valid").alias("any_valid"))
    kind = F.when(F.col("ran").isNull(), "failed_or_timeout").when(F.col("any_valid").isNull(), "empty_compare").when(~F.col("any_valid"), "fully_same")
    return tasks.select(*keys).distinct().join(has, keys, "left").join(lines, keys, "left").select(*keys, kind.alias("problem")).where("problem IS NOT NULL")


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Of tasks with equally many lines on both sides: equal lines, lines, and whether all are equal."""
    lines = aligned(keys, a=a, b=b)
    out = lines.groupBy(*keys).agg(F.count_if("has_a").alias("n_a"), F.count_if("has_b").alias("n_b"), F.count_if(F.col("has_a") & F.col("has_b") & F.col("a").eqNullSafe(F.col("b"))).alias("equal_lines"))
    return out.where("n_a = n_b").select(*keys, "equal_lines", F.col("n_a").alias("lines"), (F.col("equal_lines") == F.col("n_a")).alias("fully_same"))


def missing_from(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a row in done: what a resumed run has left to do."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def audit(tasks: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """same / diff / missing of each reference row against the tasks' value; a null value on either side is a diff."""
    mine = tasks.select(*keys, F.col(value).alias("_mine"), F.lit(True).alias("_here"))
    verdict = F.when(F.col("_here").isNull(), "missing").when(F.coalesce(F.col("_mine") == F.col(value), F.lit(False)), "same").otherwise("diff")
    return reference.join(mine, keys, "left").select(*keys, verdict.alias("verdict"))
