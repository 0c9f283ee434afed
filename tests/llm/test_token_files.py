import random
import zlib
from collections import Counter

import numpy as np
import pytest

from traceloom.llm import grammar, token_files
from traceloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([1, 2, 3, 4, 9, 50], size=rng.integers(0, 4000), p=[0.02, 0.5, 0.2, 0.1, 0.1, 0.08])
    block = grammar.compress(ids, 1, 60, least=2)
    again = grammar.Block.of(*block.columns(), block.n_ids)
    assert (again.decode() == ids).all()
    for _ in range(30):
        i, j = sorted(rng.integers(0, len(ids) + 2, 2))
        assert (again.decode(i, j) == ids[i:j]).all()
    for (a, b), n in zip(block.rules, block.lengths):  # lengths are those of the expansions
        assert n == sum(1 if s < 60 else block.lengths[s - 60] for s in (a, b))
    if len(ids) > 500:
        assert len(block.symbols) < len(ids) / 2


def plain_repair(ids, end, terminals, least):
    """Re-Pair symbol by symbol: (rules, symbols)."""
    seq, rules, closes = list(ids), [], {end}
    while True:
        counts, i = Counter(), 0
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            run = 0  # how many of one symbol stand before this place
            while pair[0] == pair[1] and i - run > 0 and seq[i - run - 1] == pair[0]:
                run += 1
            counts[pair] += pair[0] not in closes and run % 2 == 0
        pairs = sorted(p for p, n in counts.items() if n >= least)
        out, used, i = [], set(), 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) in pairs:
                out.append(tuple(seq[i : i + 2]))
                used.add(out[-1])
                i += 2
            else:
                out.append(seq[i])
                i += 1
        if not used:
            return rules, seq
        names = {p: terminals + len(rules) + k for k, p in enumerate(sorted(used))}
        rules += sorted(used)
        closes |= {n for (_, b), n in names.items() if b in closes}
        seq = [names.get(x, x) for x in out]


@pytest.mark.parametrize("seed", range(8))
def test_grammar_matches_plain_repair(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(grammar, "CELLS", 4 + seed)  # pairs share cells
    ids = rng.choice([1, 2, 3, 4, 9, 50], size=rng.integers(300, 2000), p=[0.02, 0.5, 0.2, 0.1, 0.1, 0.08])
    least = int(rng.integers(2, 9))
    block = grammar.compress(ids, 1, 60, least=least)
    rules, symbols = plain_repair(ids.tolist(), 1, 60, least)
    assert list(map(tuple, block.rules.tolist())) == rules
    assert block.symbols.tolist() == symbols
    assert len(rules) > 4 and (block.decode() == ids).all()


def test_overlaps_and_ends():
    block = grammar.compress(np.array([5] * 101 + [1] + [5] * 7 + [1]), 1, 6, least=2)
    assert (block.decode() == [5] * 101 + [1] + [5] * 7 + [1]).all()
    assert grammar.compress(np.zeros(0, np.uint16), 1, 6).decode().size == 0
    flat, starts = block.expansions()
    for i in range(len(block.rules)):
        assert 1 not in flat[starts[i] : starts[i + 1] - 1]


def plain(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    made = [(d, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")) for d, x in rows]
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].astype("<u2").tobytes()), r[1].astype("<u2").tobytes()))
    out, start = [], 0
    for d, ids in made:
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_output_matches_the_library(spark):
    rng = random.Random(3)
    words = "Hello WORLD it's a test naïve Straße ÀÉ́ 12345 a,b;c <|endoftext|> x y   ë don't…!! 日本語 \x1c\x1d".split(" ")
    rows = [(rng.randrange(500), " \n\t".join(rng.choices(words, k=rng.randrange(60)))) for _ in range(300)]
    rows += [(None, "null id"), (None, None), (7, None), (7, ""), (7, "same"), (7, "same"), (-5, "  "), (9, "long words " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS shard", "3 AS start").repartition(5)
    path = tokenizer_path()
    got = token_files.token_output(docs, path, shard_chars=20_000, block_ids=700)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain(rows, path)


def test_hot_ids_are_split(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(30))
    rows = [(None, say()) for _ in range(300)] + [(50, say()) for _ in range(300)] + [(rng.randrange(100), say()) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = tokenizer_path()
    got = token_files.token_output(docs, path, shard_chars=8_000)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain(rows, path)
    at = token_files.encoded(docs, path, limits=[-(2**63)] * 5 + [50] * 4 + [70])
    counts = {r.shard: r["count"] for r in at.groupBy("shard").count().collect()}
    assert len(counts) >= 9 and max(counts.values()) < 260


def test_random_access_and_empty(spark, tmp_path):
    path = tokenizer_path()
    docs = spark.createDataFrame([(i, f"text number {i} and more and more and more") for i in range(50)], "doc_id long, text string")
    token_files.write_tokens(docs, f"file://{tmp_path}/t", path)
    (found,) = token_files.document_ids(spark, f"file://{tmp_path}/t", 17)
    assert found.tolist() == token_files.tokenizer(path).encode([b"text number 17 and more and more and more"])[0].tolist()
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert ids[17] == found.tolist() and len(ids) == 50
    assert token_files.document_ids(spark, f"file://{tmp_path}/t", 99) == []
    assert token_files.token_output(docs.limit(0), path).count() == 0
