from traceloom.operators import sequence
from traceloom.streaming import changes


def test_changed_values_equal_the_batch_operator(spark, tmp_path):
    rows = [(f"u{i % 3}", i, str(i // 7 % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, step long, value string")
    for k in range(3):  # three files in order of step: three micro-batches
        df.where(f"step >= {k * 20} AND step < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = changes.changed_values(stream, "run", "step", "value").writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.step, r.value) for r in spark.table("changed").collect())
    want = sorted((r.run, r.step, r.value) for r in sequence.changes(df, ["run"], "step", "value").collect())
    assert got == want


def test_windowed_status(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int) * 10) AS at, if(id % 2 = 0, 'ok', 'bad') AS status FROM range(30)")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = changes.windowed_status(stream, "at", "status").writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.status, r.n) for r in spark.table("windowed").collect()) == sorted([("ok", 3), ("bad", 3)] * 5)


def test_resumed_stream(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        changes.resume_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
