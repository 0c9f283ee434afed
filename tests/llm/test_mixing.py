import hashlib
import math
from collections import Counter

import pytest

from traceloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_count(doc_id, rate, seed=11):
    draws = max(1, math.ceil(rate / mixing.STEP))
    step, total = rate / draws, 0
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-step)
        k = 0
        while c <= u and k < math.ceil(step + 12 * math.sqrt(step) + 20):
            k += 1
            p = p * step / k
            c += p
        total += k + (c <= u)
    return total


def expected(rows, weights, other=1.0, epochs=1.0):
    n = Counter(r[3] for r in rows)
    w = {s: weights.get(s, other) for s in n}
    goal = epochs * len(rows) / sum(w.values())
    return Counter({r: k for r, m in Counter(rows).items() if (k := m * plain_count(r[0], goal * w[r[3]] / n[r[3]]))})


@pytest.mark.parametrize("weights,epochs", [({}, 1.0), ({"a": 5.0, "b": 0.0}, 2.0), ({"d": 900.0}, 3.0)])
def test_counts(spark, weights, epochs):
    rows = [(i, f"t{i}", "en", "aaaaaaaabbbc"[i % 12], None) for i in range(400)] + [(900, "x", None, "d", 1), (None, None, None, None, None), (5, "again", "en", "a", 2), (5, "again", "en", "a", 2)]
    mixed = mixing.poisson_mix(spark.createDataFrame(rows, DOCS), weights, epochs=epochs)
    got = Counter(tuple(r)[:5] for r in mixed.collect())
    assert got == expected(rows, weights, epochs=epochs)
    if "b" in weights:
        assert not any(r[3] == "b" for r in got)


def test_shares_and_order(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else "cold", 1) for i in range(6000)]
    mixed = mixing.poisson_mix(spark.createDataFrame(rows, DOCS), {"hot": 1.0, "cold": 3.0}).collect()
    share = sum(r.source == "cold" for r in mixed) / len(mixed)
    assert abs(share - 0.75) < 0.02 and abs(len(mixed) - 6000) < 300
    assert [r.doc_id for r in mixed[:50]] != sorted(r.doc_id for r in mixed[:50])


def test_large_tables_of_sources_are_joined(spark, monkeypatch):
    rows = [(i, "t", "en", f"s{i % 40}", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, DOCS)
    small = Counter((r.doc_id, r.copy) for r in mixing.poisson_mix(docs, {}).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert Counter((r.doc_id, r.copy) for r in mixing.poisson_mix(docs, {}).collect()) == small


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a", 1) for i in range(50)], DOCS).selectExpr("*", "7 AS copy", "8 AS mix_at", "9 AS cdf", "1 AS row", "map('k', 1) AS `odd name`", "5 AS mix_source", "3 AS draws", "2 AS n")
    mixed = mixing.poisson_mix(docs, {"a": 2.0}, epochs=2.0)
    assert {r.copy for r in mixed.collect()} != {7} and mixed.where("cdf = 9").count() == mixed.count()
    rows = mixing.mixed_rows(docs, {"a": 2.0}, epochs=2.0)
    assert rows.columns == docs.columns and rows.where("copy = 7").count() == mixed.count()


def test_empty(spark):
    assert mixing.poisson_mix(spark.createDataFrame([], DOCS), {"a": 1.0}).count() == 0
