"""Ordered operators of finite memory as window columns: FIR filters, differences, rolling statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import clip01
from .samples import roll


def fir(x: Column, taps: np.ndarray, w: WindowSpec) -> Column:
    """Sum of taps[j] * x[i - j], zeros before the start; taps of 0 cost nothing."""
    terms = [float(t) * F.coalesce(F.lag(x, j).over(w), F.lit(0.0)) if j else float(t) * x for j, t in enumerate(taps) if t != 0.0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def differentiate(x: Column, fs: float, w: WindowSpec) -> Column:
    return (x - F.coalesce(F.lag(x, 2).over(w), F.lit(0.0))) * (fs / 2.0)


def hilbert(x: Column, taps: np.ndarray, w: WindowSpec) -> tuple[Column, Column]:
    """In-phase and quadrature parts."""
    return F.coalesce(F.lag(x, len(taps) // 2).over(w), F.lit(0.0)), fir(x, taps, w)


def envelope(x: Column, taps: np.ndarray, w: WindowSpec) -> Column:
    re, im = fir(x, taps.real, w), fir(x, taps.imag, w)
    return F.sqrt(re * re + im * im)


def moving_mean(x: Column, n: int, w: WindowSpec) -> Column:
    return F.avg(x).over(roll(w, n))


def _has_nan(x: Column, frame: WindowSpec) -> Column:
    return F.max(F.isnan(x).cast("int")).over(frame) == 1


def rolling_percentile(x: Column, pct: float, n: int, w: WindowSpec) -> Column:
    """Linear-interpolated percentile of the last n samples; NaN in the frame gives NaN. For long frames use kernels.Percentile."""
    frame = roll(w, n)
    p = min(100.0, max(0.0, pct)) / 100.0
    return F.when(_has_nan(x, frame), float("nan")).otherwise(F.percentile(x, F.lit(p)).over(frame))


def auto_range(x: Column, n: int, w: WindowSpec, low: float = 5.0, high: float = 95.0) -> Column:
    lo, hi = rolling_percentile(x, low, n, w), rolling_percentile(x, high, n, w)
    return clip01((x - lo) / F.greatest(hi - lo, F.lit(1e-9)))


def autocorrelation(x: Column, lag: int, n: int, w: WindowSpec) -> Column:
    """Of the last n samples about their mean, in [-1, 1]; 0 with fewer than lag + 2 samples or no variance."""
    if n < lag + 2:
        raise ValueError("the window has to hold lag + 2 samples")
    frame = F.collect_list(x).over(roll(w, n))
    size = F.size(frame)
    mean = F.aggregate(frame, F.lit(0.0), lambda a, v: a + v) / size
    d = F.transform(frame, lambda v: v - mean)
    total = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
    pairs = F.zip_with(F.slice(d, lag + 1, F.greatest(size - lag, F.lit(0))), F.slice(d, 1, F.greatest(size - lag, F.lit(0))), lambda a, b: a * b)
    r = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / F.when(total > 0, total)
    return F.when((size < lag + 2) | (total <= 0), 0.0).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def fraction_in_range(x: Column, low: float, high: float, n: int, w: WindowSpec) -> Column:
    """Share of the last n samples in [low, high]; an extra."""
    return F.avg(F.when((x >= low) & (x <= high) & ~F.isnan(x), 1.0).otherwise(0.0)).over(roll(w, n))
