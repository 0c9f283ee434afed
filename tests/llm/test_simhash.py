import random

import pytest
import xxhash

from traceloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum((2 * v > len(shingles)) << b for b, v in enumerate(votes))


def plain_groups(rows):
    """rows: (doc_id, fp unsigned) -> component_id of each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j in range(i):
            if (x ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "A", "one Two", "ÀÉ Straße x y z", "a b c a b c\x0bd\x1ce f", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", [1, 3, 16])
def test_links_and_components(spark, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    for _ in range(120):  # a crowd around one centre, and a chain
        x = centre
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    x = rng.getrandbits(64)
    for i in range(30):
        x ^= 3 << (2 * i)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    want = plain_groups(list(zip(range(len(fps)), fps)))
    got = {r.node: r.root for r in simhash.components(found).collect()}
    for i, a in enumerate(signed):
        for j in range(i):
            assert (got.get(a, a) == got.get(signed[j], signed[j])) == (want[i] == want[j])


@pytest.mark.parametrize("crowd", [1, 4, 20])
def test_crowds_are_cut_without_losing_a_pair(spark, monkeypatch, crowd):
    """Variants that many share: around one centre, in one segment, in one half, and far rings that no representative reaches."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    centre = rng.getrandbits(64)
    fps = set()
    for bits, places in ((4, range(64)), (5, range(32)), (3, range(32, 64)), (6, range(16)), (5, range(48, 64))):
        for _ in range(45):
            x = centre
            for b in rng.sample(places, bits):
                x ^= 1 << b
            fps.add(x)
    for x in rng.sample(sorted(fps), 40):
        fps.add(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = [(r.a, r.b) for r in found.collect()]
    assert len(set(pairs)) == len(pairs) and all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    want = plain_groups(list(zip(range(len(fps)), fps)))
    got = {r.node: r.root for r in simhash.components(found).collect()}
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_what_shares_a_variant_is_verified(spark):
    """Equal in one segment but for a bit and far apart in the other: candidates, and no link."""
    fps = [(5,), (4 | 0xFFFF << 40,), (5 | 1 << 50 | 1 << 51,)]
    df = spark.createDataFrame(fps, "fp long")
    assert simhash.candidates(df).count() == 3
    assert [(r.a, r.b) for r in simhash.links(df).collect()] == [(5, 5 | 1 << 50 | 1 << 51)]


def test_groups_match_brute_force_with_odd_rows(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("red blue green one two three four".split()) + str(rng.randrange(30)) for _ in range(300)) for _ in range(6)]
    texts = [None, "", " ", "x", "x y"] + base + base[:2]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(100 - i, t, "en", "s", None) for i, t in enumerate(texts)] + [(None, base[0], None, None, 0), (None, "alone here", None, None, 0), (7, base[1], None, None, 1), (7, base[1], None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS key", "4 AS root", "5 AS kept_id", "6 AS again_id", "map('k', 1) AS `odd name`", "7 AS row")
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id or -1) for r in simhash.simhash_groups(docs).collect())
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert got == sorted((str(d), f, c or -1) for (d, f), c in zip(fps, plain_groups(fps)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for (d, _), c in zip(fps, plain_groups(fps))}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))


def test_candidates_share_a_segment_but_for_one_bit(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(50)]
    fps += [fps[0] ^ 1 ^ 2 << 40, fps[1] ^ 7, fps[2] ^ 7 ^ 7 << 40]  # two bits; three in one segment; three in each
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.fp for r in simhash.candidates(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    near = lambda a, b: any(((a ^ b) >> s & 0xFFFFFFFF).bit_count() <= 1 for s in (0, 32))
    assert got == {signed[i] for i, a in enumerate(fps) if any(near(a, b) for j, b in enumerate(fps) if i != j)}
    assert len(got) == 4


def plain_components(edges):
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    return {frozenset(v for v in root if find(v) == r) for r in map(find, list(root))}


@pytest.mark.parametrize("shape", ["zigzag", "path", "star", "random", "stars of stars"])
def test_components_end_on_any_graph(spark, shape):
    rng = random.Random(9)
    n = 400
    order = {"zigzag": [x for i in range(n // 2) for x in (i, n - 1 - i)], "path": list(range(n))}.get(shape)
    if order:
        edges = list(zip(order, order[1:], strict=False))
    elif shape == "star":
        edges = [(n, i) for i in range(n)]
    elif shape == "random":
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
        edges = [e for e in edges if e[0] != e[1]]
    else:
        edges = [(1000 - i // 10, i) for i in range(n)] + [(1000 - i, 5000) for i in range(0, 40, 2)]
    got = {}
    for r in simhash.components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect():
        assert r.node not in got
        got[r.node] = r.root
    groups = {frozenset(v for v in got if got[v] == r) for r in set(got.values())}
    assert groups == plain_components(edges)
    assert all(r in got for r in got.values())


def test_groups_without_ids_keep_one_row_each(spark):
    a, b = "one text about rivers and stones in the north", "quite another text on ships, harbours and lights"
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (4, "x"), (4, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect()) == [("4", "x"), ("None", a), ("None", b)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
