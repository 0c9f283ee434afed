"""Quality rules by a hashed n-gram logistic regression, calibrated and held against fixed thresholds.

Fixed base rules come first (length and repetition). The verdict on the rest is a logistic regression on hashed
word 1- and 2-grams and character 3-grams (square roots of their shares, each block of unit length), trained on
labelled rows, calibrated by Platt's sigmoid on a fold that the weights haven't seen, and applied in Arrow batches.

The model is fitted on a bounded sample: at most ``per_class`` labelled documents of each class (in the order of
their ids' hash), reweighted to the true class sizes. All documents are judged, whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import in_arrow, label_sample, sampled_texts

PER_CLASS = 1500
BITS = 12
THRESHOLD = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint32(0x01000193)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint32), dtype=np.uint32)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text.

    >>> base_counts("a b c\\na b c\\n \\n#")
    (7, 7, 1, 1, 6)
    """
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    chars = len(text or "") - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return n, chars, symbols, again, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def gram_features(text: str | None) -> np.ndarray:
    """2 << BITS numbers: character 3-grams, then word 1- and 2-grams; each block has length one, or zero if empty."""
    out = np.zeros((2, 1 << BITS), np.float32)
    raw = np.frombuffer((text or "").encode(), np.uint8)
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    drop = np.uint32(32 - BITS)
    if len(points) > 2:
        h = ((points[:-2] * _BASE + points[1:-1]) * _BASE + points[2:]) * np.uint32(0x9E3779B1)
        out[0] = np.bincount(h >> drop, minlength=1 << BITS)
    gap = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.arange(len(raw) - starts[0]) + starts[0] - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        letters = np.where(gap[starts[0] :], 0, raw[starts[0] :].astype(np.uint32) + 1) * _POWERS[place & 4095]
        h = np.add.reduceat(letters.astype(np.uint32), starts - starts[0], dtype=np.uint32) * np.uint32(0x9E3779B1)
        out[1] = np.bincount(h >> drop, minlength=1 << BITS)
        if len(h) > 1:
            out[1] += np.bincount(((h[:-1] * _BASE + h[1:]) * np.uint32(0x85EBCA6B)) >> drop, minlength=1 << BITS)
    out = np.sqrt(out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).ravel()


class CalibratedGrams:
    """weights and bias of the regression, slope and offset of its calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def logit(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(features) + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent; rows of x have a squared length of two at most."""
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb, fast, rate = w, bias, 1.0, 1 / (0.25 * 3 + decay)
    for _ in range(steps):
        err = weight * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y)
        new_w, new_b = vw - rate * (x.T @ err.astype(np.float32) + decay * vw), vb - rate * err.sum()
        nxt = (1 + np.sqrt(1 + 4 * fast * fast)) / 2
        vw, vb = new_w + np.float32((fast - 1) / nxt) * (new_w - w), new_b + (fast - 1) / nxt * (new_b - bias)
        w, bias, fast = new_w, new_b, nxt
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, decay: float = 1e-5, steps: int = 300) -> CalibratedGrams | None:
    """Fit on at most 2 * per_class labelled rows; None if they lack one of the classes."""
    sample, sizes = label_sample(labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = [gram_features(t.as_py()) for t in b.column(2)]
            at = [np.flatnonzero(f).astype(np.int32) for f in feats]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([f[i] for f, i in zip(feats, at, strict=True)], pa.list_(pa.float32()))], names=["label", "held", "at", "value"])

    held = F.crc32(F.concat(F.lit("platt:"), F.col("doc_id").cast("string"))) % 5 == 0
    picked = sampled_texts(docs, sample.withColumn("held", held))
    got = picked.select("label", "held", "text").transform(in_arrow, run, "label int, held boolean, at array<int>, value array<float>").toArrow().combine_chunks()
    y, held = got.column("label").to_numpy().astype(np.float32), got.column("held").to_numpy(zero_copy_only=False).astype(bool)
    if len(y) == 0 or y.min() == y.max():
        return None
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    x = np.zeros((len(y), 2 << BITS), np.float32)
    x[np.repeat(np.arange(len(y)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy(zero_copy_only=False)] = value.flatten().to_numpy(zero_copy_only=False)
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    held = held if all((y[~held] == v).any() and (y[held] == v).any() for v in (0, 1)) else np.zeros(len(y), bool)
    w, bias = _logistic(x[~held], y[~held], weight[~held] / weight[~held].sum(), decay, steps)
    model = CalibratedGrams(w, bias)
    if held.any():  # Platt's sigmoid, with its smoothed targets
        z, t, u = model.logit(x[held]).astype(float), y[held], weight[held] / weight[held].mean()
        good, bad = (t == 1).sum(), (t == 0).sum()
        target = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g, h = u * (p - target), u * p * (1 - p) + 1e-9
            hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
            step = np.linalg.solve(hess, [(g * z).sum(), g.sum()])
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) per row.

    Null texts count as empty: zero words, which fail the base rules. Repeated rows are judged alike; a null doc_id is
    judged too. Without labels of both classes the probability is 1 and the base rules alone decide.
    """
    model = fit(docs, labels, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            counts = [base_counts(t) for t in texts]
            failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
            p = np.array([float(model.probability(gram_features(t))) for t in texts]) if model else np.ones(len(texts))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p, pa.float64())], names=NAMES)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    NAMES = ["doc_id", *names, "base_failed", "kept", "probability"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_arrow, run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, probability double")
