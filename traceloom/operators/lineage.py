"""What still holds after a change: content hashes along the graph of stages, and everything downstream of what differs.

A stage's result for a task is told by the hash of its rows, its inputs by those of the stages that it reads. What was
recorded when the stage ran is compared with what is there now; where they differ the stage is stale for that task, and so is
all that was built on it. The graph is small and closed by a recursive query; the tasks are joined to it once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.sources import folders

#: The stages that each stage reads. Sources read none.
GRAPH = {
    "code": [], "inputs": [], "predictions": [],
    "mutant": ["code"], "run": ["code", "inputs"], "mutant_run": ["mutant", "inputs"],
    "compare": ["run", "mutant_run"], "problems": ["compare"], "trace": ["code", "compare"], "graph": ["code"], "blocks": ["trace", "graph"],
    "scores": ["trace", "predictions"], "block_scores": ["blocks", "predictions"], "report": ["scores", "block_scores"],
}
#: Stages whose result is one for all tasks.
WHOLE = {"report"}


def contents(rows: DataFrame, stage: str, key: str = "task_id") -> DataFrame:
    """key, stage, hash: the content of a stage's rows for each task, whatever their order; the same rows twice are other content.

    Sums of row hashes, so that a task's rows are gathered nowhere. Columns count by name.
    """
    named = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(named), F.xxhash64(F.lit(stage), named)
    both = rows.select(F.col(key), one.cast("decimal(20,0)").alias("_one"), two.cast("decimal(20,0)").alias("_two"))
    told = F.sha2(F.concat_ws("/", F.count("*").cast("string"), F.sum("_one").cast("string"), F.sum("_two").cast("string")), 256)
    return both.groupBy(key).agg(told.alias("hash")).select(key, F.lit(stage).alias("stage"), "hash")


def all_contents(tables: dict[str, DataFrame], key: str = "task_id") -> DataFrame:
    """contents() of several stages' tables."""
    return reduce(DataFrame.unionByName, [contents(rows, stage, key) for stage, rows in tables.items()])


def edges(spark: SparkSession, graph: dict[str, list[str]]) -> DataFrame:
    """stage, needs: an edge of the graph."""
    return spark.createDataFrame([(s, n) for s, needs in graph.items() for n in needs], "stage string, needs string")


def input_hashes(found: DataFrame, graph: dict[str, list[str]], key: str = "task_id") -> DataFrame:
    """key, stage, inputs: what each task's stages read, as one hash. A stage with none of its inputs has no row; a source reads itself."""
    spark = found.sparkSession
    own = spark.createDataFrame([(s, s) for s, needs in graph.items() if not needs], "stage string, needs string")
    reads = edges(spark, {s: needs for s, needs in graph.items() if s not in WHOLE}).unionByName(own)
    rows = found.withColumnRenamed("stage", "needs").join(F.broadcast(reads), "needs")  # as many rows as the graph has edges
    return rows.groupBy(key, "stage").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "needs", "hash"))), ","), 256).alias("inputs"))


def changed(found: DataFrame, records: DataFrame, graph: dict[str, list[str]] = GRAPH, key: str = "task_id") -> DataFrame:
    """key, stage: where the inputs differ from those of the records (key, stage, inputs), or are gone. What isn't recorded holds."""
    now = input_hashes(found, graph, key)
    both = records.select(key, "stage", F.col("inputs").alias("recorded")).join(now, [key, "stage"], "left")
    return both.where(~F.col("inputs").eqNullSafe(F.col("recorded"))).select(key, "stage")


def downstream(spark: SparkSession, graph: dict[str, list[str]] = GRAPH) -> DataFrame:
    """stage, after: each stage with itself and all that is built on it, however indirectly. A cycle is an error."""
    done: set[str] = set()
    while left := [s for s in graph if s not in done]:
        ready = [s for s in left if set(graph[s]) <= done]
        if not ready:
            raise ValueError(f"the graph has a cycle, or no such stages as these need: {sorted(left)}")
        done.update(ready)
    return spark.sql(
        """
        WITH RECURSIVE built(stage, after, depth) AS (
            SELECT stage, stage, 0 FROM {stages}
            UNION ALL
            SELECT b.stage, e.stage, b.depth + 1 FROM built b JOIN {edges} e ON e.needs = b.after
        )
        SELECT DISTINCT stage, after FROM built""",
        stages=spark.createDataFrame([(s,) for s in graph], "stage string"),
        edges=edges(spark, graph),
    )


def stale(changes: DataFrame, graph: dict[str, list[str]] = GRAPH, key: str = "task_id") -> DataFrame:
    """key, stage: all that doesn't hold any more. A stage for all tasks is stale with a null key, and what is built on it too.

    A changed source is no stale result: it is there as it is.
    """
    spark = changes.sparkSession
    below = downstream(spark, graph)
    rows = changes.join(F.broadcast(below), "stage").where(~F.col("after").isin(*[s for s, needs in graph.items() if not needs]))
    whole = [r.after for r in below.where(F.col("stage").isin(*WHOLE)).select("after").distinct().collect()] if WHOLE & set(graph) else []  # stage names
    everywhere = F.col("after").isin(*whole) if whole else F.lit(False)
    return rows.select(F.when(~everywhere, F.col(key)).alias(key), F.col("after").alias("stage")).distinct()


def fresh(rows: DataFrame, void: DataFrame, stage: str, key: str = "task_id") -> DataFrame:
    """The rows of a stage's table that still hold; none if it is stale for all tasks."""
    mine = void.where(F.col("stage") == stage).select(F.col(key).alias("_void"))
    return rows.join(mine, F.col("_void").isNull() | (F.col(key) == F.col("_void")), "left_anti") if stage in WHOLE else rows.join(mine, F.col(key) == F.col("_void"), "left_anti")


def _per_task(spark: SparkSession, paths: dict[str, str], key: str) -> DataFrame:
    return all_contents({s: spark.read.parquet(p) for s, p in paths.items() if s not in WHOLE}, key)


def record(spark: SparkSession, paths: dict[str, str], records: str, stages: list[str] | None = None, graph: dict[str, list[str]] = GRAPH, key: str = "task_id") -> None:
    """Record, in the folder records, what the results of stages (all of paths, or those that just ran) were built on."""
    ran = list(paths) if stages is None else stages
    found = _per_task(spark, paths, key)
    new = input_hashes(found, graph, key).join(found.select(key, "stage"), [key, "stage"], "left_semi").where(F.col("stage").isin(*ran))
    if folders.exists(spark, records):
        new = new.unionByName(spark.read.parquet(records).where(~F.col("stage").isin(*ran)))
    new.write.mode("overwrite").parquet(f"{records}-new")
    folders.replace(spark, f"{records}-new", records)


def invalidate(spark: SparkSession, paths: dict[str, str], records: str, graph: dict[str, list[str]] = GRAPH, key: str = "task_id", drop: bool = True) -> DataFrame:
    """The stale (key, stage) of stages' tables at paths, written beside the records; with drop their rows go from tables and records.

    Without records nothing is stale. Tables are replaced whole: written beside, then moved, so a lost job leaves the old
    one. A source's rows stay; a stage that has run again is to be recorded.
    """
    void = spark.createDataFrame([], "stage string")
    if folders.exists(spark, records):
        void = stale(changed(_per_task(spark, paths, key), spark.read.parquet(records), graph, key), graph, key)
    elif paths:
        void = spark.read.parquet(next(iter(paths.values()))).select(key).limit(0).withColumn("stage", F.lit(""))
    void.write.mode("overwrite").parquet(f"{records}-stale")
    void = spark.read.parquet(f"{records}-stale")
    if not drop:
        return void
    touched = {r.stage for r in void.select("stage").distinct().collect()}  # stage names
    for stage in sorted(touched & set(paths)):
        fresh(spark.read.parquet(paths[stage]), void, stage, key).write.mode("overwrite").parquet(f"{paths[stage]}-kept")
        folders.replace(spark, f"{paths[stage]}-kept", paths[stage])
    if touched:
        kept = spark.read.parquet(records).join(void, [key, "stage"], "left_anti")
        sources = [s for s, needs in graph.items() if not needs]
        kept = kept.where(~F.col("stage").isin(*sources))
        now = input_hashes(_per_task(spark, paths, key), graph, key).where(F.col("stage").isin(*sources))
        kept.unionByName(now).write.mode("overwrite").parquet(f"{records}-new")
        folders.replace(spark, f"{records}-new", records)
    return void
