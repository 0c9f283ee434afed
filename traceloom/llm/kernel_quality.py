"""Quality scores from document statistics: random Fourier features, ridge by normal equations, isotonic calibration.

1. One pass over the texts computes a few statistics per document (about 100 bytes), stored once.
2. Standardised statistics go through cos(xW + b) with Gaussian W, an approximation of the Gaussian kernel.
3. Each partition of labelled rows sums its own Z'Z and Z'y (fixed size, whatever the row count); the sums are
   added up in two levels and the ridge system is solved on the driver.
4. Labelled rows of another fold are counted by score bin; pooling adjacent violators over the bins gives the
   calibration, interpolated between the blocks so that ties in the raw score alone are ties in the result.

Nothing is sampled: every labelled training row is in the sums, every document gets a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import id_remainder, in_arrow, stored

NAMES = (
    "log_words", "word_length", "word_length_spread", "symbols_per_word", "bangs_per_word", "bars_per_word", "upper_share",
    "digit_share", "punctuation_share", "wide_share", "byte_entropy", "distinct_words", "top_word", "repeated_next",
    "distinct_trigrams", "duplicate_lines", "log_words_per_line", "title_words",
)
FEATURES = 192
GAMMA = 0.04
RIDGE = 1e-3
#: How many partitions' sums a task adds up.
FAN_IN = 32
BINS = 2000
_SYMBOLS = [ord(c) for c in "#*$%&<>@^~=+"]
_PUNCTUATION = [ord(c) for c in ".,;:?'\"()-"]


def doc_stats(text: bytes | None) -> list[float]:
    """The statistics of one whole UTF-8 text; a null, empty or wordless text has zeros."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    bytes_in_use = seen[seen > 0] / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    trigrams = max(1, n - 2)
    return [
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float(seen[_SYMBOLS].sum() / n),
        float(seen[33] / n),
        float(seen[124] / n),
        float(seen[65:91].sum() / size),
        float(seen[48:58].sum() / size),
        float(seen[_PUNCTUATION].sum() / size),
        float(seen[128:].sum() / size),
        float(-(bytes_in_use * np.log2(bytes_in_use)).sum()),
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(map(bytes.istitle, words)) / n,
    ]


def stats_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<float>) of every row, whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [doc_stats(t.as_py()) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_arrow, run, f"doc_id {kind}, stats array<float>")


class Kernel:
    """The fitted model; apply() maps an array of statistics to scores."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.weights = rng.normal(0, math.sqrt(2 * gamma), (len(mean), features))
        self.phase = rng.uniform(0, 2 * math.pi, features)
        self.beta = np.zeros(features + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.cos(x @ self.weights + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.beta

    def apply(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def _stats_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)


def _sums(train: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows of train: one fixed-size row per partition, added up in a tree."""
    size = len(kernel.beta)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z, y = kernel.lift(_stats_of(b, 0)), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += np.hstack([z.T @ z, (z.T @ y)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py()).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    level, n = train.select("stats", "label").transform(in_arrow, partial, "total binary"), train.rdd.getNumPartitions()
    while n > FAN_IN:  # no task, nor the driver, adds up more than so many
        n = -(-n // FAN_IN)
        level = level.repartition(n).transform(in_arrow, add, "total binary")
    total = sum(np.frombuffer(bytes(r["total"])).reshape(size, size + 1) for r in level.collect())
    return total[:, :size], total[:, size]


def isotonic(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending score; knots at the blocks' mean scores."""
    blocks: list[list[float]] = []  # weighted score, good, weight
    for s, g, w in zip(score * weight, good, weight, strict=True):
        blocks.append([s, g, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    x = np.array([b[0] / b[2] for b in blocks])
    y = np.array([(b[1] + 0.5 * (0.02 + 0.96 * b[1] / b[2])) / (b[2] + 0.5) for b in blocks])
    return np.concatenate([[min(x[0], 0) - 1], x, [max(x[-1], 1) + 1]]), np.concatenate([[y[0] * 0.9], y, [1 - (1 - y[-1]) * 0.9]])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 7) -> Kernel | None:
    """Fit on labelled rows whose crc32(doc_id) modulo folds is not 0; None if they lack one of the classes.

    A fifth of them calibrates, the rest fits the ridge. Null labels and ids teach nothing; a document with
    several labels counts once for each.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("label"))
    crc = F.crc32(F.col("label_id").cast("string"))
    known = known.where(crc % folds != 0).withColumn("calibrates", F.floor(crc / folds) % 5 == 0)
    train = stored(stats.join(known, stats["doc_id"] == known["label_id"]).select("stats", "label", "calibrates"), "kernel-train")
    cells = [F.col("stats")[i].cast("double") for i in range(len(NAMES))]
    row = train.agg(F.count("*"), F.sum("label"), *[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    if not row[0] or row[1] in (0, row[0]):
        return None
    mean, spread = np.array(row[2 : 2 + len(NAMES)]), np.array(row[2 + len(NAMES) :])
    kernel = Kernel(mean, np.where(spread > 1e-9, spread, 1.0), features, gamma, seed)
    fitted = train.where(~F.col("calibrates"))
    gram, right = _sums(fitted if not fitted.isEmpty() else train, kernel)
    rows = gram[-1, -1]
    kernel.beta = np.linalg.solve(gram + np.diag([ridge * rows] * features + [1e-6 * rows]), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip((kernel.raw(_stats_of(b, 0)) + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "label"])

    held = train.where("calibrates")
    held = held if not held.isEmpty() else train
    bins = held.select("stats", "label").transform(in_arrow, binned, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    at = np.array(sorted((r["bin"], r["good"], r["n"]) for r in bins.collect()), float)  # at most BINS rows
    kernel.knots = isotonic((at[:, 0] + 0.5) * 2 / BINS - 0.5, at[:, 1], at[:, 2])
    return kernel


def score(stats: DataFrame, kernel: Kernel | None) -> DataFrame:
    """(doc_id, score); 0.5 for all if there is no model."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = kernel.apply(_stats_of(b, 1)) if kernel else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").transform(in_arrow, run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Null and empty texts have the statistics zero and the score that these get; equal texts get equal scores; a null
    doc_id has a score and is not held out. Only doc_id and text of docs are read. Empty docs give no rows.
    """
    stats = stored(stats_table(docs), "kernel-stats")
    got = score(stats, fit(stats, labels, folds=folds))
    return got.select("doc_id", (id_remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """docs without the documents that quality_scores rejects; their statistics are taken in the pass that filters."""
    stats = stored(stats_table(docs), "kernel-stats")
    kernel = fit(stats, labels, folds=folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
            stats = np.array([doc_stats(t.as_py()) for t in texts], np.float32).reshape(-1, len(NAMES)).astype(float)
            got = kernel.apply(stats) if kernel else np.full(len(stats), 0.5)
            yield b.filter(pa.array(got >= threshold))

    return docs.transform(in_arrow, run, docs.schema)
