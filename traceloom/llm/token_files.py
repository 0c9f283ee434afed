"""Token-ID output: documents to ids, in ascending doc_id order, in a file format with Re-Pair compressed blocks.

The format is a Parquet table (so its files are committed or not at all, on any file system that Spark writes to) of
blocks: shard, block, first (ids of the shard before the block), doc_ids and sizes of its documents, and the grammar
of their ids. Shards are ranges of doc_id, blocks are some millions of characters in a shard.

The texts are tokenised where they are read; two-byte ids go through one shuffle to their shard. The limits of the
shards are approximate quantiles of doc_id, so no pass over the texts is needed to find them.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import grammar
from traceloom.llm.common import in_arrow, shared_dir
from traceloom.llm.word_tokens import WordTokenizer

END = 1
SHARD_CHARS = 8_000_000
MOST_SHARDS = 20_000
LEAST_ID = -(1 << 63)
BLOCK_IDS = 1_000_000
_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, end: int = END) -> WordTokenizer:
    """One for each Python worker."""
    if (path, end) not in _TOKENIZERS:
        _TOKENIZERS[path, end] = WordTokenizer(path, end)
    return _TOKENIZERS[path, end]


def forget_tokenizers() -> None:
    """Drop this worker's tables of words."""
    _TOKENIZERS.clear()


def encoded(docs: DataFrame, path: str, end: int = END, limits: list[int] | None = None) -> DataFrame:
    """(shard, doc_id, tie, ids binary) of every row of docs.

    limits, ascending: a row's shard is the number of those below its doc_id (a null counts as the least id). A doc_id
    that several limits are equal to holds several shards' rows: they are dealt to as many by tie, the CRC-32 of the ids.
    """
    cuts, times = np.unique(np.array(limits or [], np.int64), return_counts=True)
    below = np.concatenate([[0], np.cumsum(times)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path, end)
        for b in batches:
            ids, ends = words.encode(b.column(1).cast(pa.large_binary()).to_pylist())
            places = np.concatenate([[0], ends]) * words.type.itemsize
            raw = memoryview(ids.tobytes())
            tie = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)), np.int64, b.num_rows)
            ids = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())  # a part's texts have far fewer than 2^31 bytes
            key = b.column(0).fill_null(LEAST_ID).to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, key, "left")
            shard = below[at]
            if len(cuts):
                near = np.minimum(at, len(cuts) - 1)
                shard = shard + np.where(cuts[near] == key, (tie * times[near]) >> 32, 0)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), b.column(0), pa.array(tie), ids], names=["shard", "doc_id", "tie", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, "shard int, doc_id long, tie long, ids binary")


def write_tokens(docs: DataFrame, to: str, path: str, end: int = END, shard_chars: int = SHARD_CHARS, block_ids: int = BLOCK_IDS) -> None:
    """Write docs' ids to the folder to, in ascending order of doc_id, null ids first, rows of one id by their ids' CRC-32.

    Null texts are empty texts; an empty text is its end id alone; rows that repeat a doc_id each have their place.
    A text of any length is one document of one block. An empty table writes an empty set of blocks.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + F.lit(1)).alias("n")).first()[0] or 0
    shards = min(MOST_SHARDS, math.ceil(size / shard_chars)) or 1
    limits: list[int] = []
    if shards > 1:
        places = [i / shards for i in range(1, shards)]
        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID).cast("long"))
        limits = sorted(docs.agg(F.percentile_approx(key, places, max(10_000, 20 * shards))).first()[0] or [])
    ids = encoded(docs, path, end, limits).repartitionById(len(limits) + 1, F.col("shard"))
    ids = ids.sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("ids")).drop("tie")

    kind, terminals = tokenizer(path, end).type, tokenizer(path, end).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()  # the worker has encoded all that it will
        shard, block, first = None, 0, 0
        held_ids: list[int | None] = []
        held: list[bytes] = []
        count = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(x) // kind.itemsize for x in held]
            found = grammar.compress(np.frombuffer(b"".join(held), kind), end, terminals)
            row = [shard, block, first, count, held_ids, sizes, *found.columns()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for b in batches:
            for s, d, x in zip(*b.columns, strict=True):
                s, d, x = s.as_py(), d.as_py(), x.as_py()
                if held and (s != shard or count >= block_ids):
                    yield flush()
                    block, first = (block + 1, first + count) if s == shard else (0, 0)
                    held_ids, held, count = [], [], 0
                shard = s
                held_ids.append(d)
                held.append(x)
                count += len(x) // kind.itemsize
        if held:
            yield flush()

    ids.transform(in_arrow, run, BLOCK_SCHEMA).write.parquet(to)


BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<long>, sizes array<long>, terminals int, rules binary, lengths binary, width int, symbols binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """The files' documents: (doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit numbers), each block by itself."""
    return _documents(spark, at, lambda x: x.astype("<u4").tobytes(), pa.binary(), "ids binary", "ids")


def token_digests(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files' documents."""
    return _documents(spark, at, lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long", "ids_crc32")


def _documents(spark: SparkSession, at: str, digest, kind: pa.DataType, ddl: str, name: str) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(at)
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())  # at most MOST_SHARDS rows
    before, so_far = {}, 0
    for s in sorted(totals):
        before[s] = so_far
        so_far += totals[s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = grammar.Block.of(row["terminals"], row["rules"], row["lengths"], row["width"], row["symbols"], row["n_ids"]).decode()
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                out = [digest(ids[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = before[row["shard"]] + row["first"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + first), pa.array(row["sizes"], pa.int64()), pa.array(out, kind)], names=["doc_id", "start", "n_tokens", name])

    return blocks.transform(in_arrow, run, f"doc_id long, start long, n_tokens long, {ddl}")


def document_ids(spark: SparkSession, at: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of each document of that doc_id; only the symbols that cover them are expanded."""
    found = []
    for row in spark.read.schema(BLOCK_SCHEMA).parquet(at).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("shard", "block").toLocalIterator():
        block = grammar.Block.of(row.terminals, bytes(row.rules), bytes(row.lengths), row.width, bytes(row.symbols), row.n_ids)
        ends = np.cumsum(row.sizes)
        found += [block.decode(int(e - n), int(e)) for d, n, e in zip(row.doc_ids, row.sizes, ends, strict=True) if d == doc_id]
    return found


def token_output(docs: DataFrame, path: str, end: int = END, **options) -> DataFrame:
    """Write docs' ids to files in the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32) by document."""
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(docs, to, path, end, **options)
    return token_digests(spark, to)
