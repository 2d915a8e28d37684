"""Substring dedup by relative Lempel-Ziv parsing over words.

repeats.py deals the repeated runs of words into reference blocks. A block
indexes its runs and every run is factored greedily: the longest factor that
starts earlier (smaller document, or the same document and an earlier word).
Factors of 20 words or more are duplicate; windows that cross a factor's end
are tried again from the first one that leaves the factor, so none is missed.

Null and empty texts have no words; texts under 20 words stay whole; white
space between words isn't kept; repeated rows of one id count as one document;
rows without an id are one document after all others; very long texts are
handled in pieces; extra columns are ignored; an empty table gives no rows.
Anchors of wide windows are long enough for runs of 64 windows at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats, textblock as tb

SPEC = repeats.Spec(width=20, k=8, elements="words", same=True)


def longest_factors(x: np.ndarray, first: np.ndarray, room: np.ndarray, doc: np.ndarray, start: np.ndarray, least: int) -> np.ndarray:
    """For each window the length of the longest earlier factor that starts at ``first``, 0 if under ``least``; at most ``room`` words.

    Length by length: windows whose factor of one word less has company stay.
    """
    best = np.zeros(len(first), np.int64)
    live = np.arange(len(first))
    for n in range(least, int(room.max()) + 1 if len(room) else 0):
        live = live[room[live] >= n]
        if not len(live):
            break
        g = tb.grams(x, n)[first[live]]
        order = np.lexsort((start[live], doc[live], g))
        head = repeats._heads(g[order])
        size = np.diff(np.append(head, len(order)))
        later = np.ones(len(order), bool)
        later[head] = False
        # occurrences at the same place as the first one aren't earlier
        top = np.repeat(order[head], size)
        later &= (doc[live][order] != doc[live][top]) | (start[live][order] != start[live][top])
        best[live[order[later]]] = n
        live = live[order[np.repeat(size > 1, size)]]
    return best


def verify(x: np.ndarray, bounds: np.ndarray, doc: np.ndarray, start: np.ndarray, spec: repeats.Spec) -> np.ndarray:
    count = np.diff(bounds) - spec.width + 1
    base = np.cumsum(count) - count
    run = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(run)) - base[run]
    factor = longest_factors(x, bounds[run] + inside, count[run] + spec.width - 1 - inside, doc[run], start[run] + inside, spec.width)
    early = np.zeros(len(run), bool)
    at, live = np.zeros(len(count), np.int64), np.flatnonzero(count > 0)
    while len(live):  # all runs are parsed side by side
        spot = base[live] + at[live]
        f = factor[spot]
        whole = f >= spec.width
        n = np.where(whole, f - spec.width + 1, 0)
        early[np.repeat(spot - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = True
        at[live] += np.maximum(n, 1)  # the first window that crosses the factor's end, or the next word
        live = live[at[live] < count[live]]
    return early


def _finish(rows: pa.Table, t: repeats.Texts, gone: np.ndarray) -> pa.Table:
    n, removed, sha, spans = [], [], [], []
    raw = t.data.tobytes()
    for a, b in zip(t.bounds[:-1], t.bounds[1:]):
        g = gone[a:b]
        on = np.diff(np.concatenate(([0], g.astype(np.int8), [0])))
        keep = np.flatnonzero(~g) + a
        n.append(int(b - a))
        removed.append(int(g.sum()))
        sha.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(t.s[keep].tolist(), t.e[keep].tolist())])).hexdigest())
        spans.append(np.stack([np.flatnonzero(on == 1), np.flatnonzero(on == -1)], 1).ravel().tolist())
    return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.list_(pa.int64()))})


def dedup(docs: DataFrame, width: int = SPEC.width, text: str = "text", doc_id: str = "doc_id", **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (first, end, ... of the removed words)."""
    spec = repeats.Spec(width, max(1, width * 2 // 5, width - 63), "words", True)
    return repeats.apply_repeats(docs, spec, verify, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>", text, doc_id, **sizes)
