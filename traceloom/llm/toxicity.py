"""Toxicity scores by a sparse linear classifier that is regularised against identity terms.

Features are the distinct words of a document and their prefixes of four and five letters, hashed, and each prefix once
more for how many of the document's distinct words have it, by number and share (``LEVELS``): where a language builds
its words from a few pieces, one word of a family says little and several say much. Weights are non-negative with an L1
penalty: a document is toxic for what it contains, so a long clean text can't outvote a few toxic words and words
without evidence weigh nothing.

The counterfactual penalty acts on labelled documents that mention a group: the term is swapped for another of its kind in
the text, the features of the swapped text are worked out anew, and the squared change of the score is added to the loss.
Terms are those of a list, and *neutral* ones of the sample: words that many documents of both classes hold about equally
often, swapped for others as frequent. Names of groups that the list lacks are among these where they occur.

The model is fitted on a bounded sample: at most ``per_class`` labelled documents of each class (in the order of
their ids' hash), reweighted to the true class sizes. Features are counted and chosen by Spark; the driver gets the
``SELECTED`` features at most, and what the sampled documents hold of them. All documents are scored, whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import discard, id_remainder, in_arrow, label_sample, sampled_texts, stored

PER_CLASS = 4000
HASH_BITS = 21
SELECTED = 4000
#: Levels of a feature: at least so many of the document's distinct words have it, and at least this share of them.
LEVELS = ((2, 0.01), (3, 0.01), (3, 0.03))
#: Neutral words of the sample that are swapped: how many at most, in groups of how many, and in what share of each class's documents at least.
NEUTRAL, PEERS, NEUTRAL_SHARE = 200, 4, 0.02
#: How far targets stay from 0 and 1: labels err, and without it the bias would run off until one word can't outweigh it.
SMOOTH = 0.02
WORDS = re.compile(r"[^\W\d_]+")
# Identity terms that are swapped for one another, by kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, and its prefixes of four and five letters."""
    parts = ["w:" + word] + ["p:" + word[:n] for n in (4, 5) if len(word) > n]
    return [zlib.crc32(p.encode()) & ((1 << HASH_BITS) - 1) for p in parts]


def graded(feature: int, words: int, of: int) -> list[int]:
    """A feature that so many of a document's distinct words have, and the levels that it reaches.

    >>> [f >> HASH_BITS for f in graded(5, 3, 200)], graded(5, 0, 200)
    ([0, 1, 2], [])
    """
    if not words:
        return []
    return [feature, *(feature | i << HASH_BITS for i, (least, share) in enumerate(LEVELS, 1) if words >= least and words >= share * of)]


def document_features(words: set[str]) -> set[int]:
    """The features of a text with these distinct words."""
    held = Counter(f for w in words for f in set(word_features(w)))
    return {g for f, k in held.items() for g in graded(f, k, len(words))}


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


class LexicalModel:
    """weights by feature, a bias, and a cache of each word's active features that can't outgrow its bound."""

    CACHE = 200_000

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights
        self.bases = {f & ((1 << HASH_BITS) - 1) for f in weights}
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "bases": self.bases, "cache": {}}

    def logit(self, words: Set[str]) -> float:
        held: Counter[int] = Counter()
        cache, weights = self.cache, self.weights
        for w in words:
            found = cache.get(w)
            if found is None:
                if len(cache) >= self.CACHE:
                    cache.clear()
                found = cache[w] = tuple({f for f in word_features(w) if f in self.bases})
            if found:
                held.update(found)
        return self.bias + sum(weights.get(g, 0.0) for f in sorted(held) for g in graded(f, held[f], len(words)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(distinct_words(text)), -30, 30))))


def counterfactuals(words: set[str], peers: dict[str, list[str]]) -> Iterator[tuple[str, str, list[int], list[int]]]:
    """(term, other, lost, gained) of each text that swaps a term for another of its kind: the features that change.

    >>> [(t, u) for t, u, _, _ in counterfactuals({"gay", "people"}, {"gay": ["straight"]})]
    [('gay', 'straight')]
    """
    found = sorted(words & peers.keys())
    if not found:
        return
    held = Counter(f for w in words for f in set(word_features(w)))
    n = len(words)
    # a text that already has the other word has one distinct word less after the swap, which may lift any share
    lifted = {f: more for f, k in held.items() if (more := sorted(set(graded(f, k, n - 1)) - set(graded(f, k, n))))}
    for term in found:
        own = set(word_features(term))
        for other in peers[term]:
            new = set() if other in words else set(word_features(other))
            left = n - (other in words)
            before = {g for f in own | new for g in graded(f, held[f], n)}
            after = {g for f in own | new for g in graded(f, held[f] - (f in own) + (f in new), left)}
            if left < n:
                after.update(g for f, more in lifted.items() if f not in own | new for g in more)
            yield term, other, sorted(before - after), sorted(after - before)


def sample_words(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(label, words, feats): the distinct words of the sampled rows, and their distinct features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(distinct_words(t.as_py())) for t in b.column(1)]
            feats = [sorted(document_features(set(x))) for x in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string())), pa.array(feats, pa.list_(pa.int32()))], names=["label", "words", "feats"])

    return stored(sampled_texts(docs, sample).select("label", "text").transform(in_arrow, run, "label int, words array<string>, feats array<int>"), "toxicity-sample")


def _odds(n1: float, n0: float):
    """log of the smoothed ratio of the shares of documents of class 1 and 0; columns in1 and in0 count them."""
    return F.log((F.col("in1") + 0.5) / (n1 + 1)) - F.log((F.col("in0") + 0.5) / (n0 + 1))


def _counted(rows: DataFrame, column: str) -> DataFrame:
    one = rows.select("label", F.explode(column).alias("x"))
    return one.groupBy("x").agg(F.sum("label").alias("in1"), F.sum(1 - F.col("label")).alias("in0"))


def neutral_groups(rows: DataFrame, n1: float, n0: float) -> list[list[str]]:
    """Words that documents of both classes hold about equally often, in groups of similar frequency; at most NEUTRAL words."""
    even = (F.abs(_odds(n1, n0)) < 0.25) & (F.col("in1") >= NEUTRAL_SHARE * n1) & (F.col("in0") >= NEUTRAL_SHARE * n0) & (F.col("in1") > 1)
    found = [r.x for r in _counted(rows, "words").where(even).orderBy(F.desc(F.col("in1") + F.col("in0")), "x").limit(NEUTRAL).collect()]
    return [found[i : i + PEERS] for i in range(0, len(found), PEERS)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2, per_class: int = PER_CLASS, groups=IDENTITY_TERMS, neutral: bool = True, fairness: float = 20.0, sparsity: float = 1e-4, steps: int = 800) -> LexicalModel:
    """Fit on labelled rows whose crc32(doc_id) modulo folds is not fold."""
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    sample, sizes = label_sample(known, label, per_class)
    rows = sample_words(docs, sample)
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    if not n1 or not n0:
        return LexicalModel(2.0 if n1 else -2.0, {})
    gain = _odds(n1, n0)
    best = _counted(rows, "feats").where((F.col("in1") >= 2) & (gain > 0.7)).orderBy(F.desc(gain * F.sqrt("in1")), "x").limit(SELECTED)
    chosen = np.array(sorted(r.x for r in best.select("x").collect()), np.int64)
    kinds = [list(g) for g in groups]
    listed = {t for g in kinds for t in g}
    if neutral:
        kinds += [[t for t in g if t not in listed] for g in neutral_groups(rows, n1, n0)]
    peers = {t: [x for x in g if x != t] for g in kinds for t in g}
    kept = frozenset(chosen.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats, moves = [], []
            for words, mine in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                feats.append([f for f in mine if f in kept])
                swaps = [([f for f in lost if f in kept], [f for f in gained if f in kept], len(peers[t])) for t, _, lost, gained in counterfactuals(set(words), peers)]
                moves.append([{"lost": x, "gained": y, "peers": n} for x, y, n in swaps if x or y])  # any other leaves the score as it is
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(feats, pa.list_(pa.int32())), pa.array(moves, _MOVES)], names=["label", "feats", "moves"])

    # at most 2 * per_class rows of at most SELECTED small numbers, and of the swaps of a document's terms
    got = rows.transform(in_arrow, run, "label int, feats array<int>, moves array<struct<lost: array<int>, gained: array<int>, peers: int>>").toArrow().combine_chunks()
    discard(rows)
    y = got.column("label").to_numpy().astype(float)
    n = len(y)
    lists = got.column("feats").combine_chunks()
    col = np.searchsorted(chosen, lists.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    target = SMOOTH + (1 - 2 * SMOOTH) * y
    weight = np.where(y == 1, sizes.get(1, 0) / n1, sizes.get(0, 0) / n0)
    weight /= weight.sum()
    # each different change of features is a row of the penalty, with the weight of all swaps that make it
    shares: dict[tuple[tuple[int, ...], tuple[int, ...]], float] = {}
    for w, swaps in zip(weight, got.column("moves").to_pylist(), strict=True):
        for m in swaps:
            key = tuple(m["lost"]), tuple(m["gained"])
            shares[key] = shares.get(key, 0.0) + w / m["peers"]
    entries = [(i, f, sign * np.sqrt(share)) for i, ((lost, gained), share) in enumerate(sorted(shares.items())) for sign, side in ((1, lost), (-1, gained)) for f in side]
    move, at, value = (np.array([e[j] for e in entries]) for j in range(3)) if entries else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    at = np.searchsorted(chosen, at)
    steep = 0.0
    if entries:  # no less than the square of the penalty's largest singular value
        steep = np.bincount(move, np.abs(value)).max() * np.bincount(at, np.abs(value)).max()
    w, bias = np.zeros(len(chosen)), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    bend = 0.25 * max(1.0, np.bincount(row, minlength=n).max() ** 0.5)
    rate = 1 / (bend + 2 * fairness * steep)
    fast, last_w, last_b = 1.0, w.copy(), bias
    vw, vb = w.copy(), bias
    for _ in range(steps):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(row, vw[col], n), -30, 30)))
        err = weight * (p - target)
        grad = np.bincount(col, err[row], len(chosen))
        if entries:
            change = np.bincount(move, value * vw[at], len(shares))
            grad = grad + 2 * fairness * np.bincount(at, value * change[move], len(chosen))
        w, bias = np.maximum(0, vw - rate * (grad + sparsity)), vb - rate * err.sum()
        nxt = (1 + np.sqrt(1 + 4 * fast * fast)) / 2
        vw, vb = w + (fast - 1) / nxt * (w - last_w), bias + (fast - 1) / nxt * (bias - last_b)
        last_w, last_b, fast = w, bias, nxt
    return LexicalModel(bias, {int(f): float(x) for f, x in zip(chosen, w, strict=True) if x > 1e-6})


_MOVES = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32())), ("peers", pa.int32())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs, whole texts.

    Null, empty and wordless texts get the bias alone; equal texts get equal scores; a null doc_id is scored and is not
    held out. Without labels of both classes every document gets one score, on the side of the class that is there.
    """
    model = fit(docs, labels, folds=folds, fold=fold, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_arrow, run, f"doc_id {kind}, score double")
    return got.select("doc_id", (id_remainder("doc_id", folds) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
