"""Task trees as a data source: folders or files named task_<...> below a root, read by ranges of tasks and written file by file.

    spark.dataSource.register(TaskTree)
    spark.read.format("task_tree").option("path", root).option("glob", "*.txt").load()
    rows.write.format("task_tree").option("path", root).option("name", "{task_id}/result.txt").mode("append").save()

Reading: the driver lists the names at the root alone; tasks are ordered, filtered and limited, then dealt to partitions by
ranges, and executors list and read what is in them. Only the columns of the schema are made: without text no file is
opened. Writing: each task writes beside the root; at commit the files are moved to their places, at abort removed.
Files are reached through Arrow, so any file system that it opens will do.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "task_id string, file string, size bigint, text string"
_TASK = re.compile(r"task_[^/.]+")


def task_order(task_id: str) -> tuple:
    """Tasks by number, those without one behind them, equal ones by name."""
    number = re.search(r"[0-9]+$", task_id)
    return (number is None, int(number[0]) if number else 0, task_id)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:", root, re.I) else (fs.LocalFileSystem(), root)


@dataclass
class Tasks(InputPartition):
    """The entries of a range of tasks: task_id and path, and whether it is a folder."""

    entries: list[tuple[str, str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.root = options["path"].rstrip("/")
        self.glob = options.get("glob", "*")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.by_number = options.get("order", "text") == "number"
        self.named = {x.strip() for x in options["tasks"].split(",")} if "tasks" in options else None
        self.per_partition = int(options.get("tasks_per_partition", 500))

    def partitions(self) -> list[Tasks]:
        files, path = _opened(self.root)
        entries: dict[str, list] = {}
        for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            found = _TASK.match(x.base_name)
            folder = x.type == fs.FileType.Directory
            if found and (folder or fnmatch.fnmatchcase(x.base_name, self.glob)) and (self.named is None or found[0] in self.named):
                entries.setdefault(found[0], []).append((found[0], x.path, folder))
        order = sorted(entries, key=task_order if self.by_number else None)[: self.limit]
        step = max(1, self.per_partition)
        return [Tasks([e for t in order[i : i + step] for e in sorted(entries[t])]) for i in range(0, len(order), step)] or [Tasks([])]

    def read(self, partition: Tasks) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.root)
        wanted = self.schema.names
        kinds = {"task_id": pa.string(), "file": pa.string(), "size": pa.int64(), "text": pa.string()}
        for task, path, folder in partition.entries:
            found = files.get_file_info(fs.FileSelector(path, recursive=True)) if folder else [files.get_file_info(path)]
            for x in sorted(found, key=lambda x: x.path):
                inside = x.path[len(path) + 1 :] if folder else x.base_name
                if x.type != fs.FileType.File or not fnmatch.fnmatchcase(x.base_name, self.glob):
                    continue
                row = {"task_id": task, "file": inside, "size": x.size}
                if "text" in wanted:
                    with files.open_input_stream(x.path) as f:
                        row["text"] = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds[c]) for c in wanted], names=wanted)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written beside: names of files, and how many rows were passed over."""

    names: list[str]
    skipped: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root = options["path"].rstrip("/")
        self.name = options.get("name", "{task_id}.txt")
        self.exists = options.get("exists", "overwrite" if overwrite else "skip")
        if self.exists not in ("skip", "overwrite", "error"):
            raise ValueError(f"exists is skip, overwrite or error, not {self.exists}")
        self.beside = f".writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = _opened(self.root)
        own, names, skipped = f"{root}/{self.beside}/{uuid.uuid4().hex}", [], 0
        for row in rows:
            held = row.asDict()
            if row["task_id"] is None or not _TASK.fullmatch(row["task_id"]):
                raise ValueError(f"no name of a task: {row['task_id']!r}")
            name = self.name.format(**held)
            if any(x in ("", ".", "..") for x in name.split("/")):
                raise ValueError(f"no name of a file below the root: {name!r}")
            if self.exists != "overwrite" and files.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                if self.exists == "error":
                    raise FileExistsError(f"{self.root}/{name}")
                skipped += 1
                continue
            at = f"{own}/{name}"
            files.create_dir(at.rpartition("/")[0], recursive=True)
            with files.open_output_stream(at) as f:
                f.write((row["text"] or "").encode("utf-8", "surrogatepass"))
            names.append(f"{own.rpartition('/')[2]}/{name}")
        return Written(names, skipped)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.root)
        staged = [n for m in messages if m for n in m.names]
        places = [n.partition("/")[2] for n in staged]
        if len(set(places)) < len(places):
            self.abort(messages)
            raise ValueError(f"several rows for one file: {sorted({p for p in places if places.count(p) > 1})[:5]}")
        for folder in {f"{root}/{p}".rpartition("/")[0] for p in places}:
            files.create_dir(folder, recursive=True)
        for n, place in zip(staged, places, strict=True):
            if files.get_file_info(f"{root}/{place}").type == fs.FileType.File and self.exists == "overwrite":
                files.delete_file(f"{root}/{place}")
            files.move(f"{root}/{self.beside}/{n}", f"{root}/{place}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.root)
        if files.get_file_info(f"{root}/{self.beside}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.beside}")


class TaskTree(DataSource):
    """Options for reading: path, glob, tasks (a comma list), order (text or number), limit (tasks), tasks_per_partition; for writing: path,
    name (a pattern of the row's columns), exists (skip, overwrite, error). Mode overwrite replaces files, it removes none."""

    @classmethod
    def name(cls) -> str:
        return "task_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        unknown = set(schema.names) - {"task_id", "file", "size", "text"}
        if unknown:
            raise ValueError(f"a task tree has no columns {sorted(unknown)}")
        return TreeReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if not {"task_id", "text"} <= set(schema.names):
            raise ValueError("rows need task_id and text")
        return TreeWriter(self.options, overwrite)


def task_files(spark: SparkSession, root: str, glob: str = "*", schema: str = SCHEMA, **options: str) -> DataFrame:
    """Rows of the files of a task tree (columns of schema), in no order; options as of TaskTree."""
    spark.dataSource.register(TaskTree)
    return spark.read.format("task_tree").schema(schema).options(path=root, glob=glob, **options).load()


def write_task_files(rows: DataFrame, root: str, name: str = "{task_id}.txt", exists: str = "skip") -> None:
    """A file for each row (task_id, text) below root."""
    rows.sparkSession.dataSource.register(TaskTree)
    rows.write.format("task_tree").options(path=root, name=name, exists=exists).mode("append").save()
