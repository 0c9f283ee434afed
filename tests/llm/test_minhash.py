import random

import numpy as np
import pytest

from traceloom.llm import minhash as m

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def plain(rows):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def order(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def texts(rng, n, edits, words=120):
    """n variants of one text, each with up to edits words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("crowd,block,shingles", [(64, 1024, 2_000_000), (2, 7, 2_000_000), (2, 1024, 500)])
def test_rows_match_brute_force(spark, monkeypatch, crowd, block, shingles):
    monkeypatch.setattr(m, "CROWD", crowd)
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", shingles)
    rng = random.Random(crowd + block)
    rows = [None, "", " \n\t", "x", "X", "x y", "x y z", "a b c a b c a b c", "É b c d", "é b c d", "w v " * 3000, "w v " * 2999]
    for edits in (4, 8, 12, 16):
        rows += texts(rng, 25, edits)
    chain = [f"c{i}" for i in range(150)]
    for i in range(12):  # each like the next, the last unlike the first
        rows.append(" ".join(chain[8 * i : 8 * i + 100]))
    rows = [(500 - i, t) for i, t in enumerate(rows)]
    rows += [(None, rows[20][1]), (None, "nothing like it is here"), (None, None), (7, rows[30][1]), (7, rows[30][1]), (7, rows[60][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], ROWS).selectExpr("*", "1 AS node", "2 AS sig", "3 AS key", "4 AS label", "5 AS text_hash", "6 AS of_id", "map('k', 1) AS a")
    got = m.near_duplicates(docs).collect()
    want = [(d, n, d if n == 0 else c, True if n == 0 else c == d) for d, n, c, _ in plain(rows)]
    assert order(got) == order(want)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, " ")], [(1, "only one text is here")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = m.near_duplicates(docs)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert order(got.collect()) == order([(d, len(plain_set(t)), d, True) for d, t in rows])


def test_pruning_keeps_all_but_the_miss_probability():
    """Binomial agreements at the threshold itself are dropped hardly ever, far lower similarities at the first steps."""
    rng = np.random.default_rng(3)
    zeros = np.zeros((20_000, m.HASHES), np.uint16)
    at = lambda s: len(m.surviving((rng.random(zeros.shape) > s).astype(np.uint16), zeros, 85, 1e-6)[0])
    assert at(0.85) >= 19_998
    assert at(0.5) == 0
    steps = m.least_agreements(85, 1e-6)
    assert [n for n, _ in steps] == list(range(m.STEP, m.HASHES + 1, m.STEP)) and all(k < 0.85 * n for n, k in steps)
    assert all(a <= b for (_, a), (_, b) in zip(m.least_agreements(85, 1e-9), steps))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    for keep in (0.5, 0.9):
        b = np.sort(np.concatenate([a[: int(keep * len(a))], rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(m.signature(s), "<u2") for s in (a, b))
        assert abs((x == y).mean() - j) < 0.15


def test_a_block_returns_a_forest(spark):
    """However many links a block has, it returns fewer than it has rows."""
    import pyarrow as pa

    base = np.arange(1, 200, dtype=np.uint64)
    rows = [{"node": bytes([i]), "label": bytes([i]), "side": s, "sig": m.signature(base), "hashes": base.tobytes()} for s in (0, 1) for i in range(20)]
    found = m.block_links(pa.Table.from_pylist(rows).set_column(2, "side", pa.array([r["side"] for r in rows], pa.int32())), 85, 1e-6).to_pylist()
    assert len(found) == 19
