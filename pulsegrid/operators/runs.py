"""Run lengths as window columns: dwell without tolerance, gates with hangover. With a tolerance, an observability mask or re-arming use kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import INDEX, by_session


def with_dwell(samples: DataFrame, condition: Column, count: int, name: str, reset: Column | None = None) -> DataFrame:
    """<name>_holds: the condition has been true for ``count`` samples; <name>_event: the first of them. A streak starts anew at samples of ``reset``."""
    count, w = max(1, count), by_session()
    c = F.coalesce(condition, F.lit(False))
    broken = F.when(~c, F.col(INDEX))
    if reset is not None:
        broken = broken.when(F.coalesce(reset, F.lit(False)), F.col(INDEX) - 1)
    last_false = F.max(broken).over(w.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.when(c, F.col(INDEX) - F.coalesce(last_false, F.lit(-1)))
    return samples.withColumn("_s", F.coalesce(streak, F.lit(0))).withColumn(f"{name}_holds", F.col("_s") >= count).withColumn(f"{name}_event", F.col("_s") == count).drop("_s")


def hangover(active: Column, release: int) -> Column:
    """Active, or at most ``release`` samples after the last active one."""
    w = by_session()
    last = F.max(F.when(F.coalesce(active, F.lit(False)), F.col(INDEX))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col(INDEX) - last <= release, F.lit(False))


def with_gate(samples: DataFrame, active: Column, release: int, allowed: Column, name: str) -> DataFrame:
    """<name>_gated: a gate that counts only samples at which it is allowed; elsewhere it is open and its hangover waits."""
    w = by_session().rowsBetween(Window.unboundedPreceding, 0)
    counted = samples.withColumn("_ok", F.coalesce(allowed, F.lit(False))).withColumn("_k", F.count_if("_ok").over(w))
    last = F.max(F.when(F.col("_ok") & F.coalesce(active, F.lit(False)), F.col("_k"))).over(w)
    return counted.withColumn(f"{name}_gated", F.coalesce(F.col("_ok") & (F.col("_k") - last <= release), F.lit(False))).drop("_ok", "_k")


def release_samples(release_ms: float | None, fs: float) -> int:
    """A release of 0 or none counts as 200 ms."""
    return round((release_ms or 200.0) * fs / 1000.0)
