"""The driver's contract, the oracle at a small size, and independence of the optional subpackage."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

sys.path.insert(0, str(REPO))
from traceloom.plans.catalogue import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def cells(rows):
    def cell(v):
        return "NULL" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for _, v in sorted(r.items())) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    found = duck.sql(ORACLES[name])
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["status", "tasks", "same", "total", "missing", "extra"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "traceloom"):
        subprocess.run(["cp", "-r", str(REPO / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "traceloom/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'rq1_summary' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    # the other tests are found without the folders and the pipeline, and one that reads tables passes
    subprocess.run(["cp", "-r", str(REPO / "tests"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tests/llm")], check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, check=True, capture_output=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_contract.py", "-q", "-k", "test_entry or rq1_summary"], cwd=tmp_path, check=True, capture_output=True)


def test_nothing_else_imports_the_optional_subpackage():
    for p in REPO.rglob("*.py"):
        part = p.relative_to(REPO).as_posix()
        if not part.startswith(("traceloom/llm/", "tests/")) and part not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert "traceloom.llm" not in p.read_text(), part


def test_command_line(capsys):
    from traceloom import cli

    cli.main(["list"])
    assert "rq1_summary (with SQL)" in capsys.readouterr().out
    cli.main(["run", "rq1_summary", "--data", DATA, "--limit", "3"])
    assert "|status" in capsys.readouterr().out
