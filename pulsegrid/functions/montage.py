"""Acquisition montages: stateless column expressions over channel columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channels that count as ears or mastoids.
LINKED_EARS = ("A1", "A2", "M1", "M2", "T9", "T10")


class ChannelError(ValueError):
    """A montage names a channel that the recording doesn't have."""


def _need(channels: list[str], *names: str) -> None:
    missing = [n for n in names if n not in channels]
    if missing:
        raise ChannelError(f"no channel {', '.join(missing)}; there are {', '.join(channels)}")


def _mean(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names]) / float(len(names))


def bipolar(channels: list[str], plus: str, minus: str) -> Column:
    _need(channels, plus, minus)
    return F.col(plus) - F.col(minus)


def reference(channels: list[str], kind: str, ears: tuple[str, ...] = LINKED_EARS) -> Column:
    """The reference signal: a channel, linked_ears (the mean of the ears, the common average if under two are there), common_average, or device (0)."""
    if kind == "device":
        return F.lit(0.0)
    there = [c for c in channels if c in ears]
    if kind == "linked_ears" and len(there) >= 2:
        return _mean(there)
    if kind in ("linked_ears", "common_average"):
        return _mean(channels)
    _need(channels, kind)
    return F.col(kind)


def referential(channels: list[str], active: str, ref: str, ears: tuple[str, ...] = LINKED_EARS) -> Column:
    _need(channels, active)
    return F.col(active) - reference(channels, ref, ears)


def referential_vector(vector: Column, ref: Column | None = None) -> Column:
    """All channels of an array column against one reference, by default their mean."""
    ref = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(vector) if ref is None else ref
    return F.transform(vector, lambda x: x.cast("double") - ref)


def passthrough(channels: list[str]) -> Column:
    if len(channels) != 1:
        raise ChannelError("passthrough needs exactly one channel")
    return F.col(channels[0])
