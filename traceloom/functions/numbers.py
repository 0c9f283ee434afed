"""Rounding of doubles to decimal places as Python's round() does it: by their exact value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def _halves(x: Column) -> tuple[Column, Column]:
    t = x * _SPLIT
    high = t - (t - x)
    return high, x - high


def rounded(c: Column, places: int = 4) -> Column:
    """c to places (0 to 15) decimal places, exactly as Python's round(): a double is a tie only if its binary value is one.

    x * 10^places is p + e without error: p the rounded product, e what rounding lost, from products of halves. Only where p lies
    half way between two whole numbers does e decide. From 2^53 units on a double is its own rounding. Null, NaN and infinities stay.
    """
    if not 0 <= places <= 15:
        raise ValueError(f"0 to 15 places, not {places}")
    scale = float(10**places)
    x = c.cast("double")

    def of(x: Column) -> Column:
        p = x * scale
        high, low = _halves(x)
        t = _SPLIT * scale
        s_high = t - (t - scale)
        s_low = scale - s_high
        e = (high * s_high - p) + high * s_low + low * s_high + low * s_low
        near = F.rint(p)  # ties of p to even
        d = p - near  # exact
        even = near % 2 == 0
        unit = F.when((d == 0.5) & (e > 0), near + 1).when((d == -0.5) & (e < 0), near - 1).when((d == 0) & (e == 0.5) & ~even, near + 1).when((d == 0) & (e == -0.5) & ~even, near - 1).otherwise(near)
        return F.when((F.abs(p) >= float(2**53)) | F.isnan(x), x).otherwise(unit / scale)

    # one evaluation of x, however often the formula has it
    return F.element_at(F.transform(F.array(x), of), 1)
