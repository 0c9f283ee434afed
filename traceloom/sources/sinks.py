"""Sinks: partitioned tables, resumable appends, JSON reports, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def resume(rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Append the rows whose keys path doesn't have yet; with overwrite replace the partitions that rows touch. What was written."""
    spark = rows.sparkSession
    if overwrite or not exists(spark, path):
        new = rows
    else:
        new = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    writer = new.write.partitionBy(*partition_by) if partition_by else new.write
    if overwrite and partition_by:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("overwrite" if overwrite else "append").parquet(path)
    return spark.read.parquet(path)


def json_report(summary: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """One nested document per key: its summary and its tasks in order of task_id."""
    rows = tasks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("task_id", *[c for c in tasks.columns if c not in (*keys, "task_id")]))).alias("tasks"))
    nested = F.struct(*[c for c in summary.columns if c not in keys]).alias("summary")
    return summary.select(*keys, nested).join(rows, keys, "left")


def first_case_columns(cases: DataFrame) -> DataFrame:
    """first_cases() as the two inputs of the trace stages; a task without such a case has none."""
    both = F.array(F.struct(F.lit("correct").alias("status"), F.col("correct_input").alias("literal")), F.struct(F.lit("error").alias("status"), F.col("error_input").alias("literal")))
    keys = [c for c in cases.columns if c not in ("same_line", "correct_input", "diff_line", "error_input")]
    return cases.select(*keys, F.explode(both).alias("x")).select(*keys, "x.*").where("literal IS NOT NULL")


def text_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text: the lines in order, each with its line end."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: F.concat(F.coalesce(x["value"], F.lit("")), F.lit("\n"))), "")
    return lines.groupBy(*keys).agg(joined.alias("text"))


def without_pragma(lines: DataFrame, mark: str) -> DataFrame:
    """Lines without a first line that contains mark."""
    return lines.where(~((F.col("line_no") == 1) & F.contains("value", F.lit(mark))))


def error_files(texts: DataFrame, marker: str = "ERROR: empty") -> DataFrame:
    return texts.where(F.trim("text") == marker)
