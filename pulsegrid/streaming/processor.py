"""The batch kernels under Structured Streaming: state by session, the same results for any split into micro-batches. See live.py."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.kernels import Kernel
from .live import Live, run_live


def stream_kernels(samples: DataFrame, kernels: list[Kernel], chunk: int | None = None) -> DataFrame:
    """samples: a streaming frame with session_id and sample_idx. With ``chunk``, kernels get whole chunks of that many samples."""
    return run_live(samples, Live(1.0, chunk or 1, kernels, whole=chunk is not None))


def stream_outputs(samples: DataFrame, kernels: list[Kernel], channels: list[tuple[str, str, str]], chunk: int, fs: float, muted: str | None = None, ends: DataFrame | None = None) -> DataFrame:
    """A live protocol: rows of its outputs, as outputs.emitted gives them, from one stateful pass of kernels (Map, Fir, Gate, Dwell and the rest).

    channels: (analog or event, channel, column of a kernel). ends: commands (session_id, chunk_id, name, value) that end sessions, whose last
    partial chunk then runs too.
    """
    return run_live(samples, Live(fs, chunk, kernels, channels, muted), ends)
