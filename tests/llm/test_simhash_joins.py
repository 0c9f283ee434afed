import pytest

from traceloom.llm import simhash


@pytest.fixture
def plans(monkeypatch):
    seen = []

    def noted(df, name, keep=simhash.stored):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    return seen


def test_no_join_of_the_search_goes_through_the_driver(spark, plans):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(0, 300, 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    kept = simhash.keep_one(docs)
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    groups = simhash.simhash_groups(docs)
    plans.append(("groups", groups._jdf.queryExecution().executedPlan().toString()))
    assert sum("SortMergeJoin" in p for _, p in plans) >= 6
    assert [n for n, p in plans if "Broadcast" in p] == []
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}
