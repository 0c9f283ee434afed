"""Task trees read by ranges and written with commit and abort."""

import pytest

from traceloom.sources import task_tree as t


@pytest.fixture
def tree(tmp_path):
    for i in (1, 2, 10, 3):
        (tmp_path / f"task_{i}/sub").mkdir(parents=True)
        (tmp_path / f"task_{i}/results.txt").write_text(f"r{i}\nß\n")
        (tmp_path / f"task_{i}/sub/code.py").write_text(f"x = {i}")
    (tmp_path / "task_7.txt").write_text("flat")
    (tmp_path / "task_8.txt").write_text("")
    (tmp_path / "other.txt").write_text("no task")
    (tmp_path / "task_odd.txt").write_bytes(b"\xff bad bytes")
    return tmp_path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read(spark, tree):
    got = rows(t.task_files(spark, str(tree), "*.txt"))
    assert got == sorted([(f"task_{i}", "results.txt", len(f"r{i}") + 4, f"r{i}\nß\n") for i in (1, 2, 3, 10)] + [("task_7", "task_7.txt", 4, "flat"), ("task_8", "task_8.txt", 0, ""), ("task_odd", "task_odd.txt", 11, "� bad bytes")])
    assert rows(t.task_files(spark, f"file://{tree}", "*.py", "file string, task_id string")) == sorted(("sub/code.py", f"task_{i}") for i in (1, 2, 3, 10))
    assert t.task_files(spark, str(tree / "nowhere")).count() == 0


def test_order_limit_and_names_come_before_reading(spark, tree):
    ids = lambda **o: sorted({r.task_id for r in t.task_files(spark, str(tree), "*", "task_id string", **o).collect()})
    assert ids(limit="3") == ["task_1", "task_10", "task_2"]
    assert ids(limit="3", order="number") == ["task_1", "task_2", "task_3"]
    assert ids(tasks="task_10, task_7,task_99") == ["task_10", "task_7"]
    assert ids(order="number") == sorted(["task_1", "task_10", "task_2", "task_3", "task_7", "task_8", "task_odd"])
    df = t.task_files(spark, str(tree), "*", tasks_per_partition="2")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 11


def test_files_are_opened_only_for_text(spark, tree):
    (tree / "task_9").mkdir()
    (tree / "task_9/gone.txt").symlink_to(tree / "nothing")
    assert rows(t.task_files(spark, str(tree), "results.txt", "size bigint"))[0] == (6,)


def test_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(f"task_{i}", f"text {i}\n", i) for i in range(20)] + [("task_null", None, 0)], "task_id string, text string, n int").repartition(4)
    root = str(tmp_path / "new/deep")
    t.write_task_files(df, root, "{task_id}/out_{n}.txt")
    assert rows(t.task_files(spark, root, "*", "task_id string, file string, text string")) == sorted([(f"task_{i}", f"out_{i}.txt", f"text {i}\n") for i in range(20)] + [("task_null", "out_0.txt", "")])
    assert not list(tmp_path.glob("new/deep/.writing*"))
    other = df.selectExpr("task_id", "upper(text) AS text", "n").where("n < 3 OR n = 19")
    t.write_task_files(other, root, "{task_id}/out_{n}.txt")
    assert (tmp_path / "new/deep/task_1/out_1.txt").read_text() == "text 1\n"
    t.write_task_files(other, root, "{task_id}/out_{n}.txt", exists="overwrite")
    assert (tmp_path / "new/deep/task_1/out_1.txt").read_text() == "TEXT 1\n" and (tmp_path / "new/deep/task_5/out_5.txt").read_text() == "text 5\n"
    with pytest.raises(Exception, match="out_19"):
        t.write_task_files(other.where("n = 19"), root, "{task_id}/out_{n}.txt", exists="error")


@pytest.mark.parametrize("bad", [("../up", "x"), ("task_1/../..", "x"), (None, "x")])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    df = spark.createDataFrame([("task_1", "a"), ("task_2", "b"), bad], "task_id string, text string").coalesce(1)
    with pytest.raises(Exception, match="name of a task"):
        t.write_task_files(df, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("**/*.txt"))


def test_one_row_a_file(spark, tmp_path):
    df = spark.createDataFrame([("task_1", "a"), ("task_1", "b")], "task_id string, text string").repartition(2)
    with pytest.raises(Exception, match="several rows"):
        t.write_task_files(df, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
