"""A corpus pipeline over documents: each stage reads what the one before it kept, as Parquet.

1. quality classifier: documents that the kernel quality scores reject go
2. SimHash near-dedup: of each group of near copies the document with the smallest doc_id stays
3. benchmark decontamination: documents that leak a benchmark item go
4. mixing sources: each document stays as often as its Poisson count says, zero times too
5. token-ID output: the mixture's ids are written to files and read back

All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables mean what the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import decontaminate, kernel_quality, mixing, simhash, token_files
from traceloom.llm.common import stored, table, texts
from traceloom.llm.queries import MIX_WEIGHTS, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kernel_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), whole=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, MIX_WEIGHTS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_output(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token-id output", token_stage),
]

#: The classifier and the grammar files can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, start, n_tokens, ids_crc32 of every document of the mixture."""
    docs = texts(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i + 1}")
    return docs
