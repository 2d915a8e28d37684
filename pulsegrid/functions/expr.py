"""Scalar expressions with the arithmetic of IEEE numbers where Spark's differs: NaN compares false, and a division that isn't finite is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _real(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [~F.isnan(c) for c in cols])


def div(a: Column, b: Column) -> Column:
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), 0.0).otherwise(q)


def gt(a: Column, b: Column) -> Column:
    return (a > b) & _real(a, b)


def ge(a: Column, b: Column) -> Column:
    return (a >= b) & _real(a, b)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & _real(a, b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & _real(a, b)


def eq(a: Column, b: Column) -> Column:
    return (a == b) & _real(a, b)


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


above, at_or_above, below = gt, ge, lt


def inside(x: Column, low: Column, high: Column) -> Column:
    return ge(x, low) & le(x, high)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def choose(c: Column, a: Column, b: Column) -> Column:
    """Both sides are columns already, so what they keep in state has advanced whichever is taken."""
    return F.when(c, a).otherwise(b)


def rectify(x: Column) -> Column:
    return F.abs(x)


def root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def sigmoid(x: Column, midpoint: Column | float, steepness: Column | float) -> Column:
    return 1.0 / (1.0 + F.exp(-F.lit(steepness) * (x - F.lit(midpoint))))


def linear(x: Column, midpoint: Column | float, slope: Column | float) -> Column:
    return F.lit(slope) * (x - F.lit(midpoint))


def clip01(x: Column) -> Column:
    """To [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def composite(parts: list[tuple[Column, Column | float, bool]]) -> Column:
    """Weighted mean of clipped signals (signal, weight, suppress); a suppressed one counts as 1 - signal; 0 if the weights don't sum above 0."""
    w = [F.lit(x) if not isinstance(x, Column) else x for _, x, _ in parts]
    s = [1.0 - clip01(x) if down else clip01(x) for x, _, down in parts]
    total = reduce(lambda a, b: a + b, w)
    return F.when(total > 0, reduce(lambda a, b: a + b, [a * b for a, b in zip(w, s)]) / total).otherwise(0.0)
