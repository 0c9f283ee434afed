import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from traceloom.llm import collocations as c

ROWS = "doc_id long, text string, lang string, source string"


def lowered(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def plain_counts(rows, max_n):
    f = {}
    for text, lang in rows:
        count = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            count.update(tuple(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    return f


def plain(rows, max_n=3, least=10, cover=50, top=2000):
    out = []
    for lang, f in plain_counts(rows, max_n).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        found = []
        for p, a in cand.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * held[p] < cover * a or held[p] == 0:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def sample(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a\x01", "a", "\x00", "é", "É", "x", "to", "be", "日本"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r"]) for _ in range(rng.randrange(25)))
    rows = [(text(), rng.choice(["en", "en", "fr", None])) for _ in range(n)]
    rows += [(None, "en"), ("", None), (" \t", "xx"), ("one", "yy"), ("New York City is big. new york  city!", "en")] + [("new\tyork city was", "en")] * 12
    return rows + [("to be or not to be " * 400, "en"), ("x" * 5000 + " of the", "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate(rows)], ROWS)


@pytest.mark.parametrize("max_n,least,cover,top", [(3, 10, 50, 2000), (3, 2, 90, 7), (4, 5, 50, 2000), (2, 10, 50, 3)])
def test_rows_match_plain_counts(spark, max_n, least, cover, top):
    rows = sample(max_n)
    docs = frame(spark, rows).selectExpr("*", "1 AS phrase", "2 AS n", "'x' AS suffix", "3 AS k", "4 AS words", "map('k', 1) AS score")
    got = sorted(tuple(r) for r in c.collocations(docs, max_n, least, cover, top).collect())
    assert got == plain(rows, max_n, least, cover, top)


@pytest.mark.parametrize("gathered", [1, 1 << 25])
def test_counts_of_all_phrases(spark, monkeypatch, gathered):
    monkeypatch.setattr(c, "GATHERED", gathered)
    rows = sample(8, 60)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in c.phrase_counts(frame(spark, rows), 3, 1).collect()}
    assert got == {(lang, p): n for lang, f in plain_counts(rows, 3).items() for p, n in f.items()}


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "a bb  ccc. dddd\teeeee " * 50
    want = list(c.tokens(text.encode()))
    monkeypatch.setattr(c, "CHUNK", 7)
    got = list(c.tokens(text.encode()))
    assert len(got) > 10 and sum(got, []) == sum(want, [])


@pytest.mark.parametrize("base", [3, 1 << 20, 1 << 40])
def test_distinct_rows(base):
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500) * (base // 4) for _ in range(3)]
    got, n = c.distinct_rows(columns, base)
    want = Counter(zip(*(x.tolist() for x in columns)))
    assert dict(zip(zip(*(x.tolist() for x in got)), n.tolist())) == want


def test_scores_of_large_counts_are_exact(spark):
    rng = random.Random(4)
    rows = [(10, 10, 10), (10**14, 10**14, 9 * 10**14)]
    for _ in range(50):
        a = rng.randrange(1, 10**14)
        rows.append((a, a + rng.randrange(10**14), a + rng.randrange(10**14)))
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{c.SCORE} AS s").collect()
    assert [r.s for r in got] == [10**6 * r.a * r.a // (r.l * r.r) for r in got]


def test_empty_table(spark):
    got = c.collocations(frame(spark, []))
    assert got.count() == 0
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((x, "bigint") for x in ("a", "l", "r", "n", "score"))]


def test_prefixes_over_batches_of_any_size():
    rng = random.Random(3)
    words = ["a", "ab", "b", "é", "\x01a", "a\x01"]
    for trial in range(120):
        rows, want = Counter(), Counter()
        for _ in range(rng.randrange(60)):
            lang, w, n = rng.choice(["en", "de", "e"]), [rng.choice(words) for _ in range(rng.randrange(1, 4))], rng.randrange(1, 5)
            rows[lang, " ".join(w) + " "] += n
            for k in range(1, len(w) + 1):
                want[lang, " ".join(w[:k]), k] += n
        ordered = sorted(((a.encode(), b.encode(), n) for (a, b), n in rows.items()), reverse=True)
        least, prefixes, out, at = rng.choice([1, 4]), None, [], 0
        prefixes = c.Prefixes(least, 3)
        while at < len(ordered) or not out:
            part = ordered[at : (at := at + rng.randrange(8))]
            columns = [pa.array([x.decode() for x, _, _ in part], pa.string()), pa.array([x.decode() for _, x, _ in part], pa.string()), pa.array([n for _, _, n in part], pa.int64())]
            out.append(prefixes.add(pa.RecordBatch.from_arrays(columns, names=["lang", "suffix", "n"])))
        out.append(prefixes.close())
        got = [(r["lang"], r["phrase"], r["words"], r["n"]) for b in out for r in b.to_pylist()]
        assert sorted(got) == sorted((*k, n) for k, n in want.items() if k[2] == 1 or n >= least), trial
