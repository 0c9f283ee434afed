"""Incremental reports: a stream that is stopped between putting a batch and committing it gives the report of one run."""

import pytest
from pyspark.sql import functions as F

from traceloom.sources import folders
from traceloom.streaming import reports

SCHEMA = "task_id string, attempt int, status string"


def inputs(spark, root, files=5):
    for k in range(files):
        rows = [(f"task_{i}", k, "fixed" if (i + k) % 3 == 0 else "failed") for i in range(k, k + 6)] + [(None, k, "failed")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{k}")


def stream(spark, root):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(root)


def latest(spark, path):
    return sorted(map(str, reports.report(spark, path, SCHEMA, ["task_id"], ["attempt"]).collect()))


def test_a_stopped_stream_gives_the_report_of_one_run(spark, tmp_path):
    root = f"{tmp_path}/in"
    inputs(spark, root)
    reports.incremental_report(stream(spark, root), f"{tmp_path}/once", f"{tmp_path}/ck1").awaitTermination()
    assert sorted(r.batch for r in reports.batches(spark, f"{tmp_path}/once").collect()) == [0, 1, 2, 3, 4]

    put, calls = reports.put_batch, []

    def failing(rows, batch, path):
        put(rows, batch, path)
        calls.append(batch)
        if len(calls) == 3:
            raise RuntimeError("stopped after the rows, before the commit")

    reports.put_batch = failing
    try:
        with pytest.raises(Exception):
            reports.incremental_report(stream(spark, root), f"{tmp_path}/twice", f"{tmp_path}/ck2").awaitTermination()
        seen = reports.report(spark, f"{tmp_path}/twice", SCHEMA, ["task_id"], ["attempt"])
        assert 0 < seen.count() < 11  # readable, and not all of it yet
        reports.incremental_report(stream(spark, root), f"{tmp_path}/twice", f"{tmp_path}/ck2").awaitTermination()
    finally:
        reports.put_batch = put
    assert calls == [0, 1, 2, 2, 3, 4]
    assert latest(spark, f"{tmp_path}/twice") == latest(spark, f"{tmp_path}/once")
    counts = lambda p: sorted(map(tuple, reports.batches(spark, f"{tmp_path}/{p}").collect()))
    assert counts("once") == counts("twice")


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    path = f"{tmp_path}/report"
    assert latest(spark, path) == [] and reports.batches(spark, path).count() == 0
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    reports.put_batch(make(("a", 1, "failed"), ("b", 1, "failed")), 0, path)
    reports.put_batch(make(("a", 2, "failed"), ("c", 2, "failed")), 1, path)
    reports.put_batch(make(("a", 2, "fixed")), 1, path)
    assert latest(spark, path) == ["Row(task_id='a', attempt=2, status='fixed')", "Row(task_id='b', attempt=1, status='failed')"]
    reports.put_batch(make(("b", 1, "later")), 2, path)  # equal order: the later batch
    reports.put_batch(make(("a", 0, "old")), 3, path)
    reports.put_batch(make(), 4, path)
    assert latest(spark, path) == ["Row(task_id='a', attempt=2, status='fixed')", "Row(task_id='b', attempt=1, status='later')"]
    assert not folders.exists(spark, f"{path}/batch=5")


def test_batches_go_through_batch_operators(spark, tmp_path):
    inputs(spark, f"{tmp_path}/in", 2)
    counted = lambda rows: rows.groupBy("status").agg(F.count("*").alias("n"), F.max("attempt").alias("attempt"))
    reports.incremental_report(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", counted).awaitTermination()
    got = reports.report(spark, f"{tmp_path}/out", "status string, n bigint, attempt int", ["status"], ["attempt"]).collect()
    assert {r.status: r.n for r in got} == {"fixed": 2, "failed": 5}
