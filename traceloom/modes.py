"""The mode and status dimensions, and the job matrix over them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The three variants of a task and the two outcomes.
MODES = ("original", "equivalent", "non_equivalent")
STATUSES = ("correct", "error")


def selected(choice: str, known: tuple[str, ...]) -> list[str]:
    """'all' is every known value; an unknown one is an error."""
    if choice == "all":
        return list(known)
    if choice not in known:
        raise ValueError(f"{choice!r} is none of {', '.join(known)}")
    return [choice]


def modes(spark: SparkSession, choice: str = "all") -> DataFrame:
    return spark.createDataFrame([(m,) for m in selected(choice, MODES)], "mode string")


def statuses(spark: SparkSession, choice: str = "all") -> DataFrame:
    return spark.createDataFrame([(s,) for s in selected(choice, STATUSES)], "status string")


def job_matrix(tasks: DataFrame, mode: str = "all", status: str = "all") -> DataFrame:
    """tasks with a row for each mode and status: six at most, exploded in place rather than joined."""
    rows = tasks.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in selected(mode, MODES)])))
    return rows.withColumn("status", F.explode(F.array(*[F.lit(s) for s in selected(status, STATUSES)])))


def routes(mode: str | None, status: str | None) -> list[str] | None:
    """The folders <mode>, <status> or <mode>/<status> of what is chosen, in order; None if nothing is."""
    parts = [selected(choice, known) for choice, known in ((mode, MODES), (status, STATUSES)) if choice]
    return ["/".join(x) for x in itertools.product(*parts)] if parts else None
