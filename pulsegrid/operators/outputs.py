"""Outputs of a session: analog channels by chunk, event rows, taps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip01
from .samples import CHUNK, INDEX, SESSION

# The channels that hosts know, by kind. Others are allowed.
KNOWN = {"analog": ("audio_gain", "video_clarity", "video_brightness", "ambient_density"), "event": ("audio_chime", "score_increment")}


def check_kind(kind: str, channel: str) -> None:
    """A known channel has to be used as its kind."""
    for k, names in KNOWN.items():
        if channel in names and k != kind:
            raise ValueError(f"{channel} is a channel of kind {k}")


def analog(samples: DataFrame, channel: str, value: Column, muted: Column, fs: float) -> DataFrame:
    """One row a chunk: the mean of the clipped signal, 0 where muted, at the chunk's first sample."""
    v = F.when(F.coalesce(muted, F.lit(False)), 0.0).otherwise(clip01(value))
    return samples.groupBy(SESSION, CHUNK).agg((F.min(INDEX) / fs).alias("timestamp_s"), F.avg(v).alias("value")).select(SESSION, "timestamp_s", F.lit(channel).alias("channel"), F.lit("value").alias("kind"), "value")


def events(samples: DataFrame, channel: str, fires: Column, muted: Column, fs: float) -> DataFrame:
    """One row for each sample that fires and isn't muted."""
    on = F.coalesce(fires, F.lit(False)) & ~F.coalesce(muted, F.lit(False))
    return samples.filter(on).select(SESSION, (F.col(INDEX) / fs).alias("timestamp_s"), F.lit(channel).alias("channel"), F.lit("event").alias("kind"), F.lit(None).cast("double").alias("value"))


def emitted(samples: DataFrame, channels: list[tuple[str, str, Column]], muted: Column, fs: float) -> DataFrame:
    """Rows of all channels (kind, name, column) from one aggregate: a chunk's means and the samples that fire in it (a chunk's samples at most)."""
    quiet = F.coalesce(muted, F.lit(False))
    row = lambda at, name, kind, value: F.struct((at / fs).alias("timestamp_s"), F.lit(name).alias("channel"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))
    event_row = lambda name: lambda at: row(at, name, "event", F.lit(None))
    aggs, rows = [], []
    for i, (kind, name, c) in enumerate(channels):
        if kind == "analog":
            aggs.append(F.avg(F.when(quiet, 0.0).otherwise(clip01(c))).alias(f"_c{i}"))
            rows.append(F.array(row(F.col("_first"), name, "value", F.col(f"_c{i}"))))
        else:
            aggs.append(F.collect_list(F.when(F.coalesce(c, F.lit(False)) & ~quiet, F.col(INDEX))).alias(f"_c{i}"))
            rows.append(F.transform(f"_c{i}", event_row(name)))
    return samples.groupBy(SESSION, CHUNK).agg(F.min(INDEX).alias("_first"), *aggs).select(SESSION, F.inline(F.concat(*rows)))


def taps(samples: DataFrame, last: dict[str, str], any_: dict[str, str]) -> DataFrame:
    """Chunk by chunk: the last sample of each stream in ``last``, whether any sample is true in ``any_`` (name: column)."""
    aggs = [F.max_by(c, INDEX).cast("double").alias(n) for n, c in last.items()] + [F.bool_or(c).cast("double").alias(n) for n, c in any_.items()]
    return samples.groupBy(SESSION, CHUNK).agg(*aggs)
