"""Quality rules, kernel quality and toxicity: exact parts against plain Python, models by held-out accuracy."""

import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import kernel_quality, ngram_quality, queries, toxicity

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
CLEAN = "the quick brown fox jumps over lazy dogs while many people walk along green rivers and talk about small things".split()


def sentence(rng, n, words=CLEAN):
    return " ".join(rng.choice(words) for _ in range(n))


def auc(y, s):
    y, s = np.array(y), np.array(s)
    _, inverse, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    good = y.sum()
    return (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def plain_counts(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = text.split("\n")
    again = sum(any(c not in blank for c in x) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def odd_texts():
    rng = random.Random(8)
    pieces = ["a", "b", "é", "😀", " ", "\n", "\t", " ", "\x85", "#", "|", "a b c ", "\n\n", "x\ny\n", "\x0b", "\r\n"]
    return [None, "", " \n", "a b c a b c", "one"] + ["".join(rng.choices(pieces, k=rng.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("text", odd_texts())
def test_base_counts(text):
    assert ngram_quality.base_counts(text) == plain_counts(text)


def test_features_have_unit_blocks():
    for t in odd_texts():
        f = ngram_quality.gram_features(t).reshape(2, -1)
        assert np.isfinite(f).all()
        for block in np.linalg.norm(f, axis=1):
            assert block == pytest.approx(1, abs=1e-4) or block == 0
    assert (ngram_quality.gram_features(" one two") == ngram_quality.gram_features(" one two")).all()
    words = ngram_quality.gram_features("one  two\n three").reshape(2, -1)[1]
    assert (words == ngram_quality.gram_features("\tone two three ").reshape(2, -1)[1]).all()  # white space doesn't count for words


def rows_and_labels(n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = sentence(rng, 80) + "." if good else " ".join(w + rng.choice(["%%%", "###", "$$$"]) for w in sentence(rng, 80).split())
        rows.append((i, text))
        labels.append((i, int(good), int(i % 5 == 0)))
    rows += [(None, rows[1][1]), (n, None), (n + 1, ""), (n + 2, " \n "), (3, rows[3][1]), (n + 3, "word " * 30_000)]
    labels += [(None, 1, 0), (1, None, None), (7, 1, 0), (7, 0, 1), (10**9, 1, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def small(spark):
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS score", "8 AS label", "7 AS stats", "6 AS kept")
    return rows, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules(small):
    rows, docs, labels = small
    got = ngram_quality.quality_rules(docs, labels).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(d), *ngram_quality.base_counts(t)) for d, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id < 300 and not r.base_failed:
            assert r.kept == (r.doc_id % 4 != 0)


def test_kernel_scores(spark, small):
    rows, docs, labels = small
    got = kernel_quality.quality_scores(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == int(r.doc_id % 4 != 0)
    kept = kernel_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = rng.integers(1, 30)
        x, w = np.sort(rng.random(n)) + np.arange(n), rng.integers(1, 9, n).astype(float)
        good = rng.integers(0, w + 1).astype(float)
        kx, ky = kernel_quality.isotonic(x, good, w)
        assert (np.diff(kx) >= 0).all() and (np.diff(ky) >= 0).all() and ky.min() >= 0 and ky.max() <= 1
        # min-max formula of isotonic regression
        best = [max(min(good[a : b + 1].sum() / w[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert len(set(np.round(best, 9))) == len(kx) - 2


def test_toxicity_small(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = sentence(rng, 60).split() + (["vilify" + rng.choice(["ing", "ed", "er"]), "scumbag"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(None, "scumbag"), (600, None), (601, ""), (602, "no words seen before"), (603, "vilifyxyz " + sentence(rng, 5000)), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score", "3 AS label")
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == int(r.doc_id % 6 == 0)
    by_id = {r.doc_id: r.predicted for r in got}
    assert by_id[None] == 1 and by_id[600] == by_id[601] == by_id[602] == 0 and by_id[603] == 1


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        words = sentence(rng, 40).split()
        if bad:  # labels that lean on the group alone in part
            words += [rng.choice(["awful", "vermin", "filth"])] if i % 3 else ["muslims"]
        elif i % 3 == 1:
            words += ["christians"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    free, fair = toxicity.fit(docs, known, fairness=0.0), toxicity.fit(docs, known, fairness=200.0)
    gap = lambda m: abs(m.logit({"muslims", "walk"}) - m.logit({"christians", "walk"}))
    assert gap(fair) < 0.5 * gap(free) and fair.score("people and muslims walk along rivers") < 0.3
    assert fair.score("vermin and filth") > 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, None, None)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a " * 60), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, known).count() == 2
    assert [r.score for r in kernel_quality.quality_scores(docs, known).collect()] == [0.5, 0.5]
    assert ngram_quality.quality_rules(docs, known).count() == 2
    assert kernel_quality.keep_good(docs, known).count() == 2
    for f in (toxicity.toxicity_scores, kernel_quality.quality_scores, ngram_quality.quality_rules):
        assert f(docs.limit(0), known).count() == 0


@needs_data
@pytest.mark.parametrize("name,label,least", [("op10_quality_classifier", "quality", 0.98), ("op8_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select(label, "score").collect()
    assert auc([r[0] for r in got], [r.score for r in got]) > least


@needs_data
def test_toxic_documents_are_found_held_out(spark):
    """Nine in ten of the toxic documents that taught nothing, and of the clean ones at most one in a hundred is lost."""
    got = queries.op8_toxicity(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)), n
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0)), n


@needs_data
def test_the_penalty_evens_out_groups_in_real_documents(spark):
    """Half of the toxic documents name one group and some clean ones another: the penalty shrinks what that alone scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = labels.select("doc_id", "toxic")
    group = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), " muslims").when((F.col("toxic") == 0) & (F.col("doc_id") % 7 == 0), " christians").otherwise("")
    docs = docs.join(toxic, "doc_id").select("doc_id", F.concat("text", group).alias("text"))
    free, fair = toxicity.fit(docs, labels, fairness=0.0), toxicity.fit(docs, labels)
    gap = lambda m: m.logit({"muslims"}) - m.logit({"christians"})
    assert gap(free) > 0 and gap(fair) < 0.5 * gap(free), (gap(free), gap(fair))


@needs_data
def test_rules_keep_good_documents(spark):
    got = queries.QUERIES["op2_quality_rules"](spark, DATA).where("NOT base_failed").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    good = got.where("quality = 1")
    assert good.where("kept").count() > 0.99 * good.count()
    assert got.where("quality = 0 AND kept").count() < 0.2 * got.where("quality = 0").count()


def test_counterfactuals_are_those_of_the_swapped_text():
    rng = random.Random(7)
    words = ["muslims", "muslim", "christians", "chris", "black", "blackened", "white", "walk", "whit", "jews"]
    peers = {t: [u for u in g if u != t] for g in toxicity.IDENTITY_TERMS for t in g}
    fillers = [a + b for a in "klmnp" for b in "aeiou" for _ in range(3)]
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 9)) + rng.sample(fillers, rng.choice((0, 0, 40, 70))))
        found = list(toxicity.counterfactuals(toxicity.distinct_words(text), peers))
        assert {t for t, *_ in found} == {w for w in text.split() if w in peers}
        for term, other, lost, gained in found:
            swapped = " ".join(other if w == term else w for w in text.split())
            assert set(lost) == plain_features(text) - plain_features(swapped) and set(gained) == plain_features(swapped) - plain_features(text)


def test_several_words_of_a_family_tell_more_than_one(spark):
    rng = random.Random(12)
    ends = ["ka", "lo", "mi", "nu", "pe", "ri", "so", "tu"]
    rows = []
    for i in range(900):
        words = [a + b for a, b in zip(sentence(rng, 80).split(), rng.choices(ends, k=80))]
        family = ["grumv" + e for e in rng.sample(ends, 4 if i % 6 == 0 else i % 2)]  # clean texts hold one such word by chance
        rows.append((i, " ".join(words + family)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.selectExpr("doc_id", "1 AS quality", "int(doc_id % 6 = 0) AS toxic")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known).collect()}
    assert all(r.predicted == int(d % 6 == 0) for d, r in got.items() if r.held_out)
    model = toxicity.fit(docs, known)
    long_clean = {f"word{'abcdefghij'[i % 10]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)} | {"grumvka", "grumvlo", "grumvmi"}
    assert model.logit(long_clean) < 0  # three of thousands is no family


def test_neutral_words_of_the_sample_are_swapped(spark):
    rng = random.Random(3)
    names = [f"{a}landers" for a in ("green", "iron", "north", "lake")]  # groups that the list doesn't know
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        words = sentence(rng, 20).split() + [names[i // 4 % 4]]  # each group is mentioned as often in either class
        if bad:
            words += [rng.choice(["awful", "vermin"])] if i % 3 else ["northerly"]  # shares its prefixes with one group's name
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stored = toxicity.sample_words(docs, known.selectExpr("doc_id", "toxic AS label"))
    found = {w for g in toxicity.neutral_groups(stored, 300, 900) for w in g}
    assert set(names) <= found and not found & {"awful", "vermin", "northerly"}
    free, fair = (toxicity.fit(docs, known, fairness=200.0, neutral=x) for x in (False, True))
    gap = lambda m: abs(m.logit({"northlanders"}) - m.logit({"lakelanders"}))
    assert gap(fair) <= gap(free)
    assert fair.score("the northerly people") > fair.score("the northlanders walk")


def plain_features(text):
    """The hashes of words and prefixes, and (hash, level) of what several distinct words have, packed as the model packs them."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    of = lambda w: {zlib.crc32(p.encode()) % 2**21 for p in ["w:" + w] + ["p:" + w[:n] for n in (4, 5) if len(w) > n]}
    out = set()
    for f in {f for w in words for f in of(w)}:
        k = sum(f in of(w) for w in words)
        out |= {f} | {f + (i + 1) * 2**21 for i, (least, share) in enumerate(toxicity.LEVELS) if k >= least and k / len(words) >= share}
    return out


def plain_logit(model, text):
    return model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(text))


def test_scores_match_plain_scoring(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 30, [*CLEAN, "scumbag", "vilify"] if i % 3 == 0 else CLEAN)) for i in range(300)] + [(400, None), (401, ""), (402, "x " * 20_000)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert model.weights
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, known).collect()}
    for d, t in rows:
        assert abs(got[d] - 1 / (1 + np.exp(-plain_logit(model, t)))) < 1e-9


def plain_stats(text):
    """doc_stats by its description, over characters and lists."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(kernel_quality.NAMES)
    n, size = len(words), len(raw)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    share = lambda ok: sum(map(ok, raw)) / size
    counts = [raw.count(bytes([b])) for b in set(raw)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = set(kernel_quality._SYMBOLS.tolist() if hasattr(kernel_quality._SYMBOLS, "tolist") else kernel_quality._SYMBOLS)
    marks = set(kernel_quality._PUNCTUATION.tolist() if hasattr(kernel_quality._PUNCTUATION, "tolist") else kernel_quality._PUNCTUATION)
    return [
        math.log(1 + n), mean, (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5, sum(b in symbols for b in raw) / n, raw.count(b"!") / n, raw.count(b"|") / n,
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in marks), share(lambda b: b >= 128), -sum(c / size * math.log2(c / size) for c in counts),
        len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len({tuple(words[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2),
        1 - len(set(lines)) / len(lines), math.log(1 + n / len(lines)), sum(w.istitle() for w in words) / n,
    ]


def test_document_statistics():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "Two Words", "a a a\n\nb!|\nb!|", "É 12 #$ x.", *["".join(rng.choices("abC1 .\n#!é|", k=rng.randrange(1, 400))) for _ in range(60)]]
    for t in texts:
        assert kernel_quality.doc_stats(None if t is None else t.encode()) == pytest.approx(plain_stats(t), abs=1e-9), t


@pytest.mark.parametrize("fan_in", [1, 32])
def test_kernel_scores_match_plain_algebra(spark, small, monkeypatch, fan_in):
    rows, docs, labels = small
    monkeypatch.setattr(kernel_quality, "FAN_IN", max(2, fan_in))
    known = [(r.doc_id, r.quality) for r in labels.where("quality IN (0, 1)").collect()]  # a document counts once for each of its labels
    stats = lambda t: np.array(np.float32(kernel_quality.doc_stats(None if t is None else t.encode())), float)
    crc = lambda d: zlib.crc32(str(d).encode())
    train = [(stats(t), y, crc(d) // 5 % 5 == 0) for d, t in rows for e, y in known if d is not None and d == e and crc(d) % 5]
    x, y, held = (np.array(c) for c in zip(*train, strict=True))
    spread = x.std(0)
    kernel = kernel_quality.Kernel(x.mean(0), np.where(spread > 1e-9, spread, 1.0), kernel_quality.FEATURES, kernel_quality.GAMMA, 7)
    z = kernel.lift(x[~held])
    n = len(z)
    penalty = np.diag([kernel_quality.RIDGE * n] * kernel_quality.FEATURES + [1e-6 * n])
    kernel.beta = np.linalg.solve(z.T @ z + penalty, z.T @ y[~held])
    bins = np.clip((kernel.raw(x[held]) + 0.5) * kernel_quality.BINS / 2, 0, kernel_quality.BINS - 1).astype(int)
    at = np.unique(bins)
    good, weight = (np.array([f(bins == b) for b in at], float) for f in (lambda m: y[held][m].sum(), np.sum))
    kernel.knots = kernel_quality.isotonic((at + 0.5) * 2 / kernel_quality.BINS - 0.5, good, weight)
    want = sorted((str(d), float(kernel.apply(stats(t)[None])[0])) for d, t in rows)
    got = sorted((str(r.doc_id), r.score) for r in kernel_quality.quality_scores(docs, labels).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)


def plain_grams(text):
    """gram_features by loops: shares' square roots of hashed grams, each block of length one."""
    size, mask = 1 << ngram_quality.BITS, 0xFFFFFFFF
    base, drop = int(ngram_quality._BASE), 32 - ngram_quality.BITS
    out = [[0.0] * size, [0.0] * size]
    points = [ord(c) for c in text or ""]
    for a, b, c in zip(points, points[1:], points[2:]):
        out[0][(((a * base + b) * base + c) * 0x9E3779B1 & mask) >> drop] += 1
    hashes = []
    for word in (text or "").encode().split():
        h, power = 0, 1
        for k, letter in enumerate(word):
            h += (letter + 1) * int(ngram_quality._POWERS[k % 4096])
        hashes.append(h * 0x9E3779B1 & mask)
    for h in hashes:
        out[1][h >> drop] += 1
    for a, b in zip(hashes, hashes[1:]):
        out[1][((a * base + b) * 0x85EBCA6B & mask) >> drop] += 1
    roots = [[x**0.5 for x in block] for block in out]
    return [x / (sum(v * v for v in block) ** 0.5 or 1.0) for block in roots for x in block]


def test_grams_and_probabilities_match_plain_loops(small):
    rows, docs, labels = small
    rng = random.Random(4)
    for t in [None, "", "a", "ab cd", "x" * 5000, *["".join(rng.choices("abé 日\n.x", k=rng.randrange(300))) for _ in range(30)]]:
        assert ngram_quality.gram_features(t).tolist() == pytest.approx(plain_grams(t), abs=1e-5)
    model = ngram_quality.fit(docs, labels)
    got = {(str(r.doc_id), r.n_words): r.probability for r in ngram_quality.quality_rules(docs, labels).collect()}
    for d, t in rows[:40]:
        z = sum(a * b for a, b in zip(plain_grams(t), model.weights.tolist(), strict=True)) + model.bias
        assert got[str(d), len((t or "").encode().split())] == pytest.approx(1 / (1 + math.exp(-(model.slope * z + model.offset))), abs=1e-4)


@needs_data
def test_rules_on_documents_that_taught_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = ngram_quality.quality_rules(docs, labels.where(~part)).where("NOT base_failed").join(labels.where(part), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0)), n
