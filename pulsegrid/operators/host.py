"""Run kernels over samples: one shuffle by session, one Python pass for all of them.

Partitions are sorted by session and sample; a task takes its Arrow batches as they come, steps the kernels over numpy slices
of each session in a batch, and gives one batch back for each: columns that no kernel writes pass through untouched. State is
dropped when a session ends, so memory holds one batch and one session's state.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import Columns, Kernel
from .samples import CHUNK, INDEX, SESSION


def advance(kernels: list[Kernel], columns: Columns, bounds: np.ndarray | None = None) -> Columns:
    """What the kernels add to consecutive rows of one session; later kernels see earlier outputs. bounds: where chunks begin, and the end."""
    have, new = dict(columns), {}
    for k in kernels:
        given = {c: have[c] for c in k.inputs}
        out = k.step_chunks(given, bounds) if k.chunked and bounds is not None else k.step(given)
        have |= out
        new |= out
    return new


def feed(kernels: list[Kernel], rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one session in order, with the kernels' columns."""
    return rows.assign(**advance(kernels, {c: rows[c].to_numpy() for c in rows.columns}))


def output_schema(samples: DataFrame, kernels: list[Kernel]) -> T.StructType:
    """The samples' columns, then the kernels'; all may be null (a kernel's NaN is null)."""
    made = {name: kind for k in kernels for name, kind in k.outputs.items()}
    fields = [T.StructField(f.name, f.dataType, True, f.metadata) for f in samples.schema.fields if f.name not in made]
    return T.StructType([*fields, *[T.StructField(name, T.BooleanType() if kind == "boolean" else T.DoubleType()) for name, kind in made.items()]])


def as_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Null numbers are NaN, null booleans false."""
    if pa.types.is_boolean(column.type):
        column = column.fill_null(False)
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _edges(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Rows at which one of the columns changes; nulls are equal to one another."""
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def with_kernels(samples: DataFrame, kernels: list[Kernel], by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """``by``: the columns whose values make a session (segments.py runs pieces of sessions). samples needs session_id and sample_idx, and chunk_id if a kernel's values belong to chunks: chunks are then fed whole.

    All other kernels get as much of a session as a batch holds. Rows with a null session are one session.
    """
    schema = output_schema(samples, kernels)
    made = [name for k in kernels for name in k.outputs]
    kept = [n for n in schema.fieldNames() if n not in made]
    made = [n for n in schema.fieldNames() if n in made]
    kinds = [pa.bool_() if isinstance(schema[n].dataType, T.BooleanType) else pa.float64() for n in made]
    chunked = any(k.chunked for k in kernels) and CHUNK in samples.columns
    inputs = {c for k in kernels for c in k.inputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, live, rest = None, None, None
        for batch in itertools.chain(batches, [None]):
            end = batch is None
            if rest is not None:
                batch = rest if end else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                rest = None
            if batch is None or not batch.num_rows:
                continue
            if chunked and not end:  # the last chunk may go on in the next batch
                cut = int(_edges(batch, [*by, CHUNK])[-1])
                batch, rest = batch.slice(0, cut), batch.slice(cut)
                if not cut:
                    continue
            starts = _edges(batch, list(by))
            ends = [*starts[1:].tolist(), batch.num_rows]
            marks = np.append(_edges(batch, [*by, CHUNK]), batch.num_rows) if chunked else None
            columns = {c: as_numpy(batch.column(c)) for c in inputs if c in batch.schema.names}
            out = {n: np.zeros(batch.num_rows, bool if k == pa.bool_() else float) for n, k in zip(made, kinds)}
            for a, b in zip(starts.tolist(), ends):
                key = [batch.column(c)[a].as_py() for c in by]
                if live is None or key != session:
                    session, live = key, [k.anew() for k in kernels]
                bounds = None if marks is None else marks[np.searchsorted(marks, a) : np.searchsorted(marks, b) + 1] - a
                for name, values in advance(live, {c: v[a:b] for c, v in columns.items()}, bounds).items():
                    out[name][a:b] = values
            arrays = [pa.array(out[n], k, from_pandas=k != pa.bool_()) for n, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *arrays], [*kept, *made])

    return samples.repartition(*by).sortWithinPartitions(*by, INDEX).mapInArrow(run, schema)
