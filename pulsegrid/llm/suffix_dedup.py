"""Suffix-array dedup: bytes that a window of 50 bytes covers which also starts in a document with a smaller id are removed.

repeats.py brings the candidate runs of windows together; their bytes are
ordered by two-stage suffix sorting, adjacent common prefixes of 50 bytes or
more join equal windows, and each takes the smallest document id of its group.

Null and empty texts have nothing to remove; texts under 50 bytes stay whole;
exact copies of 50 bytes or more keep only the smallest id's; extra columns are
ignored; an empty table gives no rows; very long texts are handled in pieces.
Null ids come after all others; rows of one id (or of none) are one document.
Anchors of wide windows are long enough for runs of 64 windows at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .suffix_array import adjacent_prefixes, two_stage

SPEC = repeats.Spec(width=50, k=20, elements="bytes", same=False)
SEPARATOR = 0xFF  # in no UTF-8 text


def _first_document(x: np.ndarray, bounds: np.ndarray, doc: np.ndarray, spec: repeats.Spec) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)
    t = np.full(len(x) + len(n), SEPARATOR, np.uint8)
    t[np.arange(len(x)) + np.repeat(np.arange(len(n)), n)] = x
    run = np.repeat(np.arange(len(n)), n + 1)
    left = np.repeat(bounds[1:] + np.arange(len(n)), n + 1) - np.arange(len(t))  # bytes up to the separator
    sa, w = two_stage(t, spec.width)
    sa = sa[left[sa] >= spec.width]
    group = np.flatnonzero(adjacent_prefixes(sa, w, spec.width) < spec.width)
    least = np.minimum.reduceat(doc[run[sa]], group) if len(group) else np.zeros(0, np.int64)
    least = np.repeat(least, np.diff(np.append(group, len(sa))))
    order = np.argsort(sa)
    return run[sa][order], least[order]


def verify(x: np.ndarray, bounds: np.ndarray, doc: np.ndarray, start: np.ndarray, spec: repeats.Spec) -> np.ndarray:
    """A window has an earlier occurrence if its group's smallest document is smaller than its own."""
    run, least = _first_document(x, bounds, doc, spec)
    return least < doc[run]


def _finish(rows: pa.Table, t: repeats.Texts, gone: np.ndarray) -> pa.Table:
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
    for a, b in zip(t.offs[:-1], t.offs[1:]):
        g = gone[a:b]
        on = np.diff(np.concatenate(([0], g.astype(np.int8), [0])))
        first, end = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
        out["n_bytes"].append(int(b - a))
        out["n_removed"].append(int(g.sum()))
        out["n_spans"].append(len(first))
        out["kept_sha256"].append(hashlib.sha256(t.data[a:b][~g].tobytes()).hexdigest())
        out["spans"].append(np.stack([first, end], 1).ravel().tolist())
    return pa.table({"doc_id": rows.column("doc_id"), **{k: pa.array(v, pa.list_(pa.int64()) if k == "spans" else pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}})


def dedup(docs: DataFrame, width: int = SPEC.width, text: str = "text", doc_id: str = "doc_id", **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end, start, end ... of the removed bytes)."""
    spec = repeats.Spec(width, max(min(SPEC.k, max(1, width * 2 // 5)), width - 63), "bytes", False)
    return repeats.apply_repeats(docs, spec, verify, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>", text, doc_id, **sizes)
