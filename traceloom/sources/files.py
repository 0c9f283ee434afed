"""Readers: text, code, JSON and listings of task trees as tables with fixed schemas, through Spark's own file readers."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import schemas
from traceloom.functions import text
from traceloom.sources import folders

TASK = r"(task_[^/.]+)"


def listing(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, size of the files under root, without their contents; empty files too, which Spark's readers pass over."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    paths = spark.createDataFrame([(unquote(p),) for p in rows.inputFiles()], "path string")
    sizes = rows.select(F.col("path").alias("sized"), F.col("length").alias("size"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    both = paths.join(sizes, plain(F.col("path")) == plain(F.col("sized")), "left")
    return both.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.coalesce("size", F.lit(0)).alias("size"))


def tasks_of(files: DataFrame, limit: int | None = None, numeric: bool = False) -> DataFrame:
    """Distinct task_id of paths, by text or by number, the first limit of them."""
    ids = files.select(F.regexp_extract("path", TASK, 1).alias("task_id")).where("task_id <> ''").distinct()
    ids = ids.orderBy(*([text.task_number(F.col("task_id"))] if numeric else []), "task_id")
    return ids if limit is None else ids.limit(limit)


def whole_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, task_id and text of whole files."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.regexp_extract(path, TASK, 1).alias("task_id"), F.col("value").alias("text"))


def result_lines(spark: SparkSession, root: str, glob: str, mode: str, source: str) -> DataFrame:
    """RESULT_LINES of files of one line per value; an empty file has none."""
    rows = text.numbered_lines(whole_texts(spark, root, glob), ["task_id"], "text")
    return rows.select(F.lit(mode).alias("mode"), F.lit(source).alias("source"), "task_id", "line_no", "value")


def marked_valid(lines: DataFrame, marker: str = schemas.INVALID_LINE) -> DataFrame:
    """COMPARE_LINES of a compare file: lines of the marker are no valid cases."""
    return lines.withColumn("is_valid", F.col("value") != marker)


def input_literals(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """INPUTS: stripped lines, blank ones out, numbered anew."""
    rows = text.numbered_lines(whole_texts(spark, root, glob), ["task_id"], "text")
    kept = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("line_no", text.strip(F.col("value")).alias("v")))).alias("x"))
    kept = kept.select("task_id", F.filter(F.transform("x", lambda s: s["v"]), lambda v: v != "").alias("v"))
    return kept.select("task_id", F.posexplode("v").alias("p", "literal")).select("task_id", (F.col("p") + 1).alias("line_no"), "literal")


def raw_outputs(spark: SparkSession, root: str, mode: str, output_name: str) -> DataFrame:
    """RAW_OUTPUTS of the task_*.txt files of one output set."""
    rows = whole_texts(spark, f"{root.rstrip('/')}/{output_name}", "task_*.txt")
    return rows.select(F.lit(mode).alias("mode"), F.lit(output_name).alias("output_name"), "task_id", F.col("text").alias("raw"))


def json_documents(spark: SparkSession, root: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One row per whole-file JSON document."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(root)


def repair_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of repair reports, one row per repaired task."""
    return json_documents(spark, root, schemas.REPAIR_REPORT).select("model_name", F.explode("results").alias("r")).select("model_name", "r.*")


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """TASKS from a snapshot of the dataset in JSON or Parquet; a test may be one text or a list."""
    raw = spark.read.parquet(root) if root.rstrip("/").endswith("parquet") else spark.read.option("multiLine", "true").json(root)
    test = F.col("test") if dict(raw.dtypes).get("test", "string") == "string" else F.array_join("test", "\n")
    lists = F.col("test_list") if "test_list" in raw.columns else F.array().cast("array<string>")
    number = F.regexp_extract(F.col("task_id").cast("string"), r"([0-9]+)$", 1).cast("int")
    return raw.select(F.concat(F.lit("task_"), number).alias("task_id"), number.alias("task_num"), "code", test.alias("test"), lists.alias("test_list"))


def delta_trace(spark: SparkSession, root: str) -> DataFrame:
    """Steps of JSON-lines delta traces: path, func, line and changes."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root).withColumn("path", F.col("_metadata.file_path"))
    return rows.select("path", F.from_json("value", schemas.DELTA_TRACE).alias("s")).where("s IS NOT NULL").select("path", "s.*")


def template(spark: SparkSession, path: str | None) -> str:
    """The text of one small file, such as the footer that every script gets; "" without one."""
    if not path or not folders.exists(spark, path):
        return ""
    found = spark.read.text(path, wholetext=True).first()
    return found.value if found else ""  # an empty file has no row


def span_maps(spans: DataFrame, keys: list[str], file: str) -> DataFrame:
    """keys, json: spans (keys, iid, variable and place) as one document a program, its iids with their places in the file."""
    place = F.struct(F.lit(file).alias("file"), *[c for c in spans.columns if c not in (*keys, "iid")])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("iid"), place.alias("place")))))
    return spans.groupBy(*keys).agg(F.to_json(F.struct(entries.alias("iid_to_location"))).alias("json"))


def iid_spans(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """SPAN_MAP and variable from the documents of span_maps(), or others with iid_to_location, below root: path, iid and its place."""
    place = "struct<file:string,variable:string,start_line:int,start_column:int,end_line:int,end_column:int>"
    rows = whole_texts(spark, root, glob).select("path", F.from_json("text", f"struct<iid_to_location:map<string,{place}>>").alias("d"))
    return rows.select("path", F.explode("d.iid_to_location").alias("iid", "place")).select("path", "iid", "place.*")


def span_names(writes: DataFrame, spans: DataFrame) -> DataFrame:
    """Writes (path, iid) with the source span of iid: a small dimension that adaptive execution broadcasts; spans missing are null."""
    return writes.join(spans, ["path", "iid"], "left")


def from_environment(value: str) -> str:
    """${NAME} as the environment has it, "" if it doesn't; other texts as they are."""
    found = re.fullmatch(r"\$\{(\w+)\}", value or "")
    return os.environ.get(found[1], "") if found else value
