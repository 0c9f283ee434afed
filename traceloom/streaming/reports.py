"""Reports that grow while their stage runs: each micro-batch puts its rows beside the others, and can be put again.

A batch is written out of sight and then moved to the folder of its id, so a batch that a restarted stream repeats replaces
its own rows and no reader sees part of one. A reader gets the latest row of each key from what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from traceloom.sources import folders


def put_batch(rows: DataFrame, batch: int, path: str) -> None:
    """The rows of a micro-batch as batch=<id> below path, in place of what an earlier try of the same batch left there."""
    spark = rows.sparkSession
    beside = f"{path}/.batch-{batch}-{uuid.uuid4().hex}"  # readers skip names with a dot
    rows.write.parquet(beside)
    folders.replace(spark, beside, f"{path}/batch={batch}")


def incremental_report(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Start a stream into the report at path: what is there now and then an end, or a batch every so often ("10 seconds").

    prepare: what becomes of a micro-batch first, any batch operator. A stopped stream goes on from the same checkpoint; a batch
    that was put but not committed comes again with its id.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, batch: put_batch(prepare(rows) if prepare else rows, batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def report(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key in a report, by order and then by batch; at any time, also before the first batch.

    Null keys are a key of their own; of rows with equal order in one batch one is taken.
    """
    empty = spark.createDataFrame([], schema)
    if not folders.exists(spark, path):
        return empty
    rows = spark.read.schema(StructType([*empty.schema.fields, *spark.createDataFrame([], "batch bigint").schema.fields])).parquet(path)
    others = [c for c in empty.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, "batch")).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in empty.columns])


def batches(spark: SparkSession, path: str) -> DataFrame:
    """batch and n (its rows) of a report."""
    if not folders.exists(spark, path):
        return spark.createDataFrame([], "batch bigint, n bigint")
    return spark.read.parquet(path).groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("n"))
