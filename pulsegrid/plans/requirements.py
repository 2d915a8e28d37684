"""What a protocol needs of a recording, checked before a job starts."""

from __future__ import annotations

from pyspark.sql import DataFrame


class RequirementError(ValueError):
    pass


def sample_rate(least: float | None, offered: list[float] | None) -> float:
    """The highest offered rate that is enough; without an offer the least one, or 256 Hz."""
    if not offered:
        return least or 256.0
    enough = [r for r in offered if r >= (least or 0.0)]
    if not enough:
        raise RequirementError(f"none of {offered} Hz reaches {least} Hz")
    return max(enough)


def channels(samples: DataFrame, needed: list[str], groups: dict[str, list[str]] | None = None) -> list[str]:
    """The needed channels, groups written out; all have to be columns of the samples."""
    names = [c for n in needed for c in (groups or {}).get(n, [n])]
    missing = [c for c in names if c not in samples.columns]
    if missing:
        raise RequirementError(f"the recording lacks {', '.join(missing)}")
    return names


def coupling(needed: str | None, offered: list[str] | None) -> str | None:
    """The needed coupling; an amplifier that names what it offers has to have it."""
    if needed and offered is not None and needed not in offered:
        raise RequirementError(f"coupling {needed} isn't among {offered}")
    return needed
