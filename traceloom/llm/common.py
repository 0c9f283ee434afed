"""What the operators of this subpackage share: shared storage, table access, bounded label samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, whatever file system the directory is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. One file may be one row group, which is one task however many cores there are: it is dealt to all of them."""
    df = table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Only where the session names none and all runs on this machine, as in local tests, a folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The table is written once through Spark's commit protocol, so lost executors cost only the tasks
    they ran, and later readers need nothing of what made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove stored() tables that nothing reads any more: those of a loop, which later ones replace."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes that an operator gets at once: whole texts are long, and a worker holds a part and what it makes of it.
PART_ROWS = 1000
PART_BYTES = 16 << 20


def give_back() -> None:
    """Free memory of Arrow's pool and of the C heap goes back to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most PART_ROWS rows and, but for a single row, PART_BYTES bytes; order as it was."""
    rows = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.num_rows > 1 and part.nbytes > PART_BYTES:  # long texts stand together
            for i in range(part.num_rows):
                yield part.slice(i, 1)
        else:
            yield part


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow() over the parts of its batches, which Spark bounds in bytes; memory that a task has freed goes back to the machine."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for b in batches for part in parts(b))
        give_back()

    return df.mapInArrow(bounded, schema)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once although f may use it for each element of something."""
    return F.transform(F.array(x), f)[0]


def id_remainder(column: str, modulus: int):
    """crc32 of an id's decimal text modulo modulus; -1 for a null id, which no label can name."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1)).cast("int")


def label_sample(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """At most per_class labelled ids of each class, in the order of their hash, and the class sizes.

    The bound is a documented parameter of each classifier that uses it: the sample has at most
    2 * per_class rows of two small columns, so a broadcast of it has a proven size.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: float(r["n"]) for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [kept.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionAll(parts[1]), sizes


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The columns of sample (doc_id, label and any others) but doc_id, and text, one row per sampled id that docs has.

    Of rows that repeat an id the text with the smallest hash is taken, so the result is no larger than the sample.
    """
    others = [c for c in sample.columns if c != "doc_id"]
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").alias("text_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    found = texts.join(F.broadcast(sample), F.col("text_id") == F.col("doc_id"))
    return found.groupBy("doc_id").agg(F.min_by("text", "text_hash").alias("text"), *[F.first(c).alias(c) for c in others]).select(*others, "text")
