"""Folders of the file systems that Spark reads: moves, removals and a scratch place, whatever the scheme of the path."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """The folder new takes the place of old, which goes if it is there."""
    files, at = _path(spark, old)
    _, source = _path(spark, new)
    files.delete(at, True)
    files.mkdirs(at.getParent())
    if not files.rename(source, at):
        raise OSError(f"{new} can't be moved to {old}")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors see: spark.checkpoint.dir, or where all runs on this machine and none is set a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="traceloom-")
