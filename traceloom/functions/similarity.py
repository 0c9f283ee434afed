"""Sequence similarity on arrays of strings: edit distance, accuracy, error classes.

The edit distance of short pairs encodes each distinct item as one character and lets the built-in levenshtein do the work in the
JVM; the pair's dictionary is projected first, so that it is computed once per row. Both steps grow with the product of the
lengths, so long pairs go to a bit-parallel distance over Arrow, which takes any items: 30 or 60 cells of the table at once.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: A pair is long if the product of its lengths is more, or their sum more than there are characters of one plane.
LONG = 1_000_000
CODES = 50_000
#: Bytes of bit masks that a long pair keeps.
MASK_BYTES = 64 << 20


def bit_distance(a: list, b: list) -> int:
    """Unit-cost edit distance of two sequences of any hashable items, a column of the table at a time as bits of whole numbers.

    >>> bit_distance(list("kitten"), list("sitting")), bit_distance([], [1, 2]), bit_distance([None, 1], [None, 1])
    (3, 2, 0)
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    rows, columns = (a, b) if len(a) >= len(b) else (b, a)
    if not columns:
        return len(rows)
    places: dict = {}
    for i, x in enumerate(rows):
        places.setdefault(x, []).append(i)
    masks: OrderedDict = OrderedDict()
    held = 0
    m = len(rows)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for x in columns:
        equal = masks.get(x)
        if equal is None:
            bits = bytearray(m // 8 + 1)
            for i in places.get(x, ()):
                bits[i >> 3] |= 1 << (i & 7)
            equal = masks[x] = int.from_bytes(bits, "little")
            held += m // 8
            while held > MASK_BYTES and len(masks) > 1:  # made again if it comes again
                masks.popitem(last=False)
                held -= m // 8
        across = equal | down
        along = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(along | up)) & full, up & along
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(across | more)) & full, more & across & full
    return score


@F.pandas_udf(IntegerType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else bit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _encoded(items: Column, names: Column) -> Column:
    place = lambda x: F.array_position(names, x).cast("int") + 0x100
    one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    # places from 0xD800 on are no characters of their own
    return F.array_join(F.transform(items, lambda x: one(F.when(place(x) >= 0xD800, place(x) + 0x800).otherwise(place(x)))), "")


def edit_distance(pairs: DataFrame, a: str, b: str, out: str = "distance", long: int = LONG) -> DataFrame:
    """pairs with the unit-cost edit distance of two array columns, whatever their lengths and items.

    Null arrays are empty ones; a null item equals a null item. Pairs whose lengths multiply to more than long (or add up to
    more than CODES) are compared by bit_distance(): a row of theirs is one call, so its cost is that of its own lengths alone.
    """
    rows = pairs.withColumn("_a", F.coalesce(F.col(a), F.array())).withColumn("_b", F.coalesce(F.col(b), F.array()))
    is_long = (F.size("_a").cast("long") * F.size("_b") > long) | (F.size("_a") + F.size("_b") > CODES)
    rows = rows.withColumn("_long", _long_distance(F.when(is_long, F.col("_a")), F.when(is_long, F.col("_b"))))
    short = lambda c: F.when(is_long, F.array().cast("array<string>")).otherwise(F.transform(F.col(c), lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("")))).alias(c)
    rows = rows.withColumns({"_a": short("_a"), "_b": short("_b")})
    rows = rows.withColumn("_names", F.array_distinct(F.concat(F.col("_a"), F.col("_b"))))
    rows = rows.withColumn("_a", _encoded(F.col("_a"), F.col("_names"))).withColumn("_b", _encoded(F.col("_b"), F.col("_names")))
    return rows.withColumn(out, F.coalesce("_long", F.levenshtein("_a", "_b"))).drop("_a", "_b", "_names", "_long")


def similarity(distance: Column, a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty sequences. Not rounded."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, 1.0).otherwise(1 - distance / longer)


def value_accuracy(truth: Column, predicted: Column) -> Column:
    """Share of places of truth where predicted has the same; of an empty truth 1 if predicted is empty too, else 0."""
    same = F.size(F.filter(F.zip_with(truth, F.slice(predicted, F.lit(1), F.size(truth)), lambda t, p: t.eqNullSafe(p)), lambda x: x))
    # zip_with pads the shorter with nulls, which only a null in truth would equal
    padded = F.size(F.filter(F.slice(truth, F.size(predicted) + 1, F.greatest(F.size(truth) - F.size(predicted), F.lit(0))), lambda t: t.isNull()))
    return F.when(F.size(truth) == 0, F.when(F.size(predicted) == 0, 1.0).otherwise(0.0)).otherwise((same - padded) / F.size(truth))


def error_class(truth: Column, predicted: Column, truth_values: Column, predicted_values: Column) -> Column:
    """The first class that fits a predicted block path and its values."""
    one, two = F.array_sort(F.array_distinct(truth)), F.array_sort(F.array_distinct(predicted))
    same_path = truth.eqNullSafe(predicted)
    return (
        F.when(same_path & truth_values.eqNullSafe(predicted_values), "PERFECT")
        .when(same_path, "PATH_OK_VALUE_ERR")
        .when((one == two) & (F.size(truth) != F.size(predicted)), "WRONG_ITER_COUNT")
        .when(one == two, "WRONG_ORDER")
        .when(F.size(F.array_except(predicted, truth)) > 0, "WRONG_BRANCH")
        .when(F.size(predicted) < F.size(truth), "EARLY_TERMINATION")
        .otherwise("MIXED_ERROR")
    )


def final_correct(truth_values: Column, predicted_values: Column) -> Column:
    """Whether the last values are the same, and there are any."""
    last = F.try_element_at(truth_values, F.lit(-1))
    return F.coalesce((F.size(truth_values) > 0) & (F.size(predicted_values) > 0) & (last == F.try_element_at(predicted_values, F.lit(-1))), F.lit(False))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (truth_path, pred_path, truth_values, pred_values) with distance, similarity, accuracy, class, final_correct and reasoning_illusion."""
    rows = edit_distance(pairs, "truth_path", "pred_path")
    t, p, tv, pv = (F.coalesce(c, F.array()) for c in ("truth_path", "pred_path", "truth_values", "pred_values"))
    rows = rows.withColumn("block_similarity", similarity(F.col("distance"), t, p)).withColumn("value_accuracy", value_accuracy(tv, pv)).withColumn("error_type", error_class(t, p, tv, pv))
    rows = rows.withColumn("path_exact", t == p).withColumn("values_exact", tv == pv).withColumn("final_correct", final_correct(tv, pv))
    return rows.withColumn("reasoning_illusion", F.col("final_correct") & ~F.col("path_exact"))
