"""Roll-ups of scores: variable traces, block traces, statuses, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import numbers


def variable_scores(truth: DataFrame, predicted: DataFrame, keys: list[str], result: str = "result") -> DataFrame:
    """Per task on both sides: variables compared and matched by raw text, whether result matches; skipped where a side lacks it.

    The side with fewer variables is the base, so compared is the smaller number; matches are the same from either side.
    """
    one = truth.select(*keys, "var", F.col("value").alias("t"), F.lit(1).alias("in_t"), F.lit(None).cast("string").alias("p"), F.lit(0).alias("in_p"))
    two = predicted.select(*keys, "var", F.lit(None).cast("string").alias("t"), F.lit(0).alias("in_t"), F.col("value").alias("p"), F.lit(1).alias("in_p"))
    each = one.unionAll(two).groupBy(*keys, "var").agg(F.max("t").alias("t"), F.max("p").alias("p"), F.max("in_t").alias("in_t"), F.max("in_p").alias("in_p"))
    both = (F.col("in_t") == 1) & (F.col("in_p") == 1)
    same = both & F.col("t").eqNullSafe(F.col("p"))
    out = each.groupBy(*keys).agg(
        F.sum("in_t").alias("n_truth"), F.sum("in_p").alias("n_pred"), F.count_if(same).alias("vars_matched"),
        F.count_if(both & (F.col("var") == result)).alias("has_result"), F.count_if(same & (F.col("var") == result)).alias("result_matched"),
    ).where("n_truth > 0 AND n_pred > 0")
    skipped = F.col("has_result") == 0
    zero = lambda c: F.when(skipped, F.lit(0)).otherwise(c).cast("bigint")
    compared = F.least("n_truth", "n_pred")
    return out.select(*keys, skipped.alias("skipped"), zero(compared).alias("vars_compared"), zero(F.col("vars_matched")).alias("vars_matched"), (~skipped & (F.col("result_matched") > 0)).alias("result_match"), (~skipped & (F.col("vars_matched") == compared)).alias("all_match"))


def variable_rollup(scores: DataFrame, label: str) -> DataFrame:
    """Counts and rates by label and in total (label 'total'); rates are null of nothing."""
    agg = scores.rollup(label).agg(
        F.count_if(~F.col("skipped")).alias("valid_files"), F.count_if("skipped").alias("skipped_files"), F.count_if("result_match").alias("result_matches"),
        F.count_if("all_match").alias("all_matches"), F.sum("vars_matched").alias("vars_matched"), F.sum("vars_compared").alias("vars_compared"), F.grouping(label).alias("_total"),
    )
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return agg.select(F.when(F.col("_total") == 1, "total").otherwise(F.col(label).cast("string")).alias("label"), "valid_files", "skipped_files", "result_matches", "all_matches", "vars_matched", "vars_compared", rate("result_matches", "valid_files").alias("result_rate"), rate("all_matches", "valid_files").alias("all_rate"), rate("vars_matched", "vars_compared").alias("variable_rate"))


def block_rollup(scored: DataFrame, label: str) -> DataFrame:
    """Means and counts of scored pairs by label and in total; means are over pairs, not over rounded labels."""
    agg = scored.rollup(label).agg(
        F.count("*").alias("files"), F.avg("block_similarity").alias("avg_similarity"), F.avg("value_accuracy").alias("avg_value_accuracy"), F.count_if("path_exact").alias("path_exact"),
        F.count_if("values_exact").alias("values_exact"), F.count_if("final_correct").alias("final_correct"), F.count_if("reasoning_illusion").alias("reasoning_illusions"), F.grouping(label).alias("_total"),
    )
    return agg.select(F.when(F.col("_total") == 1, "total").otherwise(F.col(label).cast("string")).alias("label"), *[c for c in agg.columns if c not in (label, "_total")])


def rounded_rollup(by_label: DataFrame, places: int = 4) -> DataFrame:
    """The total as the mean of labels' rounded means, weighted by their files: for comparison with reports made that way."""
    rows = by_label.where("label <> 'total'")
    mean = lambda c: F.try_divide(F.sum(numbers.rounded(F.col(c), places) * F.col("files")), F.sum("files")).alias(c)
    return rows.agg(F.sum("files").alias("files"), mean("avg_similarity"), mean("avg_value_accuracy"))


def error_distribution(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or []), "error_type").agg(F.count("*").alias("n"))


def by_count(rows: DataFrame, by: list[str], what: str, seen: str) -> DataFrame:
    """by, what, n and place: the values of a column by falling count, of equal counts the one that was seen first (smallest seen).

    Ranks are over counts, a row per value; give groups by where there are many values.
    """
    counts = rows.groupBy(*by, what).agg(F.count("*").alias("n"), F.min(seen).alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_first"))).drop("_first")


def output_variables(lines: DataFrame, keys: list[str], sequence: str = "block_sequence", default: str = "result") -> DataFrame:
    """keys, variable: the first name of a trace's lines (line_no, value) that isn't the block sequence's."""
    name = F.expr("""trim(BOTH '"' FROM trim(BOTH "'" FROM trim(split_part(value, ':', 1))))""")
    named = lines.select(*keys, "line_no", F.when(F.contains("value", F.lit(":")), name).alias("_name"))
    first = F.min(F.when(F.col("_name") != sequence, F.struct("line_no", "_name")))["_name"]
    return named.groupBy(*keys).agg(F.coalesce(first, F.lit(default)).alias("variable"))


def status_counts(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*by, status).agg(F.count("*").alias("n"))


def status_pivot(rows: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """One row per group, one column per status; a count of 0 where there is none."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values], F.count("*").alias("total"))


def merged_distributions(*parts: DataFrame) -> DataFrame:
    """Counts by error_type added up over several distributions."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("error_type").agg(F.sum("n").alias("n"))


def repair_outcomes(results: DataFrame) -> DataFrame:
    """Per task of repair results: attempts, the attempt that was accepted, reasons seen; and its status."""
    tries = results.select("task_id", "status", F.explode_outer("attempts").alias("a"))
    out = tries.groupBy("task_id", "status").agg(F.count("a").alias("attempts"), F.min(F.when(F.col("a.ok"), F.col("a.attempt"))).alias("accepted_at"), F.array_sort(F.collect_set("a.reason")).alias("reasons"))
    return out.withColumn("fixed", F.col("accepted_at").isNotNull())
