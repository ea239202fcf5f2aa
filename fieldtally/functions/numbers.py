"""Number columns: coercion, sentinels, guarded ratios. Null, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, or null when the value does not read as a number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def non_negative(c: Column) -> Column:
    number = to_number(c)
    return F.when(number >= 0, number)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def finite_unit(c: Column) -> Column:
    """Infinity becomes null, the rest is bounded to [0, 1]."""
    number = to_number(c)
    return clip(F.when(F.abs(number) < float("inf"), number), 0, 1)


def guarded_ratio(num: Column, den: Column) -> Column:
    """num/den bounded to [0, 1] where den is positive, else null."""
    n, d = to_number(num), to_number(den)
    return clip(F.when(d > 0, n / d), 0, 1)


def positive_flag(c: Column) -> Column:
    return F.coalesce(to_number(c) > 0, F.lit(False)).cast("int")


def at_most_flag(c: Column, limit: float) -> Column:
    return F.coalesce(to_number(c) <= limit, F.lit(False)).cast("int")


def any_present_flag(*cols: Column) -> Column:
    return F.coalesce(*cols).isNotNull().cast("int")


def all_present_flag(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]).cast("int")


def missing_share(*cols: Column) -> Column:
    """Share of null values in a row."""
    return total(c.isNull().cast("int") for c in cols) / F.lit(float(len(cols)))


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, list(cols))


def bands(c: Column, edges, labels) -> Column:
    """Right-closed bands (edge, next edge]; null outside all of them."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        test = (c > low) & (c <= high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def step(c: Column, edges) -> Column:
    """How many of the ascending edges the value has reached (0 … len)."""
    return total((c >= F.lit(float(e))).cast("int") for e in edges)
