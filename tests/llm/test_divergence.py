import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from traceloom.llm import divergence as d

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(rows, least=3, top=200):
    """All rows by the definition, in Python's whole numbers. rows: (text, lang, source)."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)) for t, _, _ in rows]
    out = []
    for lang in {x[1] for x in rows}:
        mine = [(w, s) for w, (_, x, s) in zip(terms, rows) if x == lang]
        df = Counter(t for w, _ in mine for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for w, s in mine:
            counts[s].update(t for t in w if df[t] >= least)
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def p(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q = p(whole)
        for s in {x for _, x in mine}:
            ps = p(counts[s])
            pair = [(o, sum((ps[t] - y) ** 2 // y for t, y in p(counts[o]).items())) for o in {x for _, x in mine} if o != s]
            term = [(t, (ps[t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] > 0 and ps[t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None) for i, (t, lang, s) in enumerate(rows)], ROWS)


def sample(seed):
    rng = random.Random(seed)
    words = ["Straße", "ÉTÉ", "a", "the", "The", "über", "x1y", "zz", "don't", "日本", "q\x00r", "ﬁ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(None, None, None), ("", "en", "none"), ("...", "xx", "alone"), ("only here", "yy", "s"), ("w " * 3000, "en", "s1")]
    for _ in range(120):
        s = rng.choice(["s1", "s1", "s1", "s2", "s3", None])
        rows.append((" ".join(rng.choice(words[: 12 if s == "s2" else None]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), s))
    return rows + rows[-4:]


@pytest.mark.parametrize("cells", [1_000_000, 25])
def test_rows_match_plain_arithmetic(spark, cells, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CELLS", cells)
    rows = sample(3)
    docs = frame(spark, rows).selectExpr("*", "1 AS term", "2 AS n", "'x' AS item", "3 AS block", "4 AS docs", "map('k', 1) AS value")
    got = sorted(tuple(r) for r in d.source_divergence(docs).collect())
    assert got == plain(rows)


def test_top_cuts_terms_only_and_ties_go_to_the_smaller_item(spark):
    rows = [("b a c d é", "en", "s1")] * 3 + [("x y z", "en", "s2")] * 3 + [("z", "en", f"t{i}") for i in range(5)]
    got = sorted(tuple(r) for r in d.source_divergence(frame(spark, rows), top=2).collect())
    assert got == plain(rows, top=2)
    assert [r[3] for r in got if r[:3] == ("en", "s1", "term")] == ["a", "b"]
    assert sum(r[2] == "pair" for r in got) == 7 * 6


def test_a_language_that_keeps_no_term_has_pairs_of_zero(spark):
    got = sorted(tuple(r) for r in d.source_divergence(frame(spark, [("a b", "en", "s1"), ("c", "en", "s2")])).collect())
    assert got == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]


def test_empty_table(spark):
    got = d.source_divergence(frame(spark, []))
    assert got.count() == 0
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_slices_of_equal_hashes_but_other_bytes_are_parted():
    text = b"aa bb aa cc ccc bb dd"
    data = np.frombuffer(text, np.uint8)
    starts, ends = d.term_slices(data, np.array([0, len(text)]))
    words = [text[a:b] for a, b in zip(starts, ends)]
    assert words == text.split()
    for digest in (lambda w: 7, lambda w: w[0] % 2, d.xxhash.xxh64_intdigest):
        ids, first = d.grouped_slices(text, starts, ends, digest)
        assert [words[first[i]] for i in ids] == words
        assert len(set(ids.tolist())) == len(set(words))


def test_terms_do_not_cross_texts():
    texts = pa.array(["ab", "cd", None, "", "e"]).slice(1)
    got = d.part_counts(["l"] * 4, ["s"] * 4, texts).to_pydict()
    assert sorted(got["term"]) == ["cd", "e"]


def test_scaled_is_exact_for_large_counts():
    rng = random.Random(2)
    pairs = [(a, b) for b in (1, 7, 10**9, 9 * 10**15, rng.randrange(1, 9 * 10**15)) for a in (0, 1, b // 3, b - 1, b) if 0 <= a <= b]
    got = d.scaled(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [10**9 * a // b for a, b in pairs]
