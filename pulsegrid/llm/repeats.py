"""Repeated windows across a corpus: cells of documents, buckets of anchors.

A window is ``width`` consecutive elements (bytes or words). Its anchor is the
smallest-hashed ``k``-gram in it, so equal windows have equal anchors. Rows:

1. Documents are dealt into *cells* of bounded size by a hash of doc_id. The
   exchange of texts is the only one that carries whole texts.
2. Each cell lists the runs of windows that share an anchor (h: the anchor's
   hash, c: a hash of the run's content), made distinct, with the first
   occurrence, packed by *bucket* of h.
3. A bucket keeps the anchors that occur elsewhere and asks the cell of the
   first occurrence of each (h, c) for the elements of that run.
4. A bucket gets the runs and a ``verify`` function (suffix sorting or
   relative parsing) compares the elements themselves; it says for every run
   which windows of its first occurrence have an earlier one.
5. Cells get those marks back and apply them to their documents.

A run of windows that occurs in a third of all documents is one entry for each
cell, so hot content is aggregated before it is shuffled. Cells and buckets
grow in number with the input, not in size. Hashes keep 48 bits of h and 48 of
c; content under equal h is compared by its elements.

Null ids come after all others; rows with the same id count as one document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, textblock as tb

U = tb.U
LOW = U((1 << 48) - 1)
#: Bytes of text for each cell and for each bucket.
CELL_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
#: Bytes of runs that are compared at once; runs with one anchor stay together.
VERIFY_BYTES = 2 << 20


@dataclass(frozen=True)
class Spec:
    """width: elements of a window; k: elements of an anchor; elements: 'bytes' or 'words'; same: earlier windows of the same document count."""

    width: int
    k: int
    elements: str
    same: bool


@dataclass
class Runs:
    """Runs of windows: document row, first window, number of windows, hashes."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    h: np.ndarray
    c: np.ndarray


@dataclass
class Texts:
    """Documents of a cell. bounds: of the elements of each document; x: the words' hashes; s, e: bytes of the words."""

    ids: np.ndarray
    data: np.ndarray
    offs: np.ndarray
    bounds: np.ndarray
    x: np.ndarray | None
    s: np.ndarray | None
    e: np.ndarray | None


GRAPH = tb.is_word("graph")


def texts(table: pa.Table, spec: Spec) -> Texts:
    data, offs = tb.buffers(table.column("text"))
    doc = tb.ids(table.column("doc_id"))
    if spec.elements == "bytes":
        return Texts(doc, data, offs, offs, None, None, None)
    s, e, x = tb.words(data, offs, GRAPH, False)
    return Texts(doc, data, offs, np.searchsorted(s, offs), x, s, e)


def runs(t: Texts, spec: Spec) -> Iterator[Runs]:
    """All runs, in document order."""
    w, k = spec.width, spec.k
    reach = w - k + 1  # anchors in a window
    for i, j, a, b in tb.slices(t.bounds, w - 1):
        n = b - a
        if n < w:
            continue
        x = tb.byte_values(t.data[a:b]) if t.x is None else t.x[a:b]
        g = tb.mix(tb.grams(x, k))
        whole = tb.grams(x, w)
        low = (g >> U(20) << U(20)) | np.arange(len(g), dtype=U)
        size = 1
        while size * 2 <= reach:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < reach:
            low = np.minimum(low[: n - w + 1], low[reach - size :][: n - w + 1])
        anchor = (low & U((1 << 20) - 1)).astype(np.int64)
        lo = np.maximum(t.bounds[i:j], a) - a
        hi = np.minimum(t.bounds[i + 1 : j + 1], b) - a
        fits = np.zeros(n - w + 2, np.int64)
        room = hi - lo >= w
        np.add.at(fits, lo[room], 1)
        np.add.at(fits, hi[room] - w + 1, -1)
        ok = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
        if not len(ok):
            continue
        anc = anchor[ok]
        first = np.flatnonzero(np.append(True, anc[1:] != anc[:-1]))
        last = np.append(first[1:], len(ok)) - 1
        s0, s1 = ok[first], ok[last]
        row = i + np.searchsorted(t.bounds[i : j + 1], s0 + a, "right") - 1
        c = tb.mix(whole[s0] * U(3) + whole[s1] * U(5) + (s1 - s0).astype(U))
        yield Runs(row, s0 + a - t.bounds[row], s1 - s0 + 1, g[anc[first]] & LOW, c & LOW)


def all_runs(t: Texts, spec: Spec) -> Runs:
    parts = list(runs(t, spec))
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z.astype(U), z.astype(U))
    return Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "start", "count", "h", "c")))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted key tuples change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _parts(key: np.ndarray) -> list[np.ndarray]:
    """Row numbers for each value of ``key``."""
    order = np.argsort(key, kind="stable")
    return np.split(order, _heads(key[order])[1:]) if len(key) else []


def _blob(rows: list[dict], names: list[str], key: str, also: str = "") -> pa.Table:
    """Rows as a table: a number to group by, packed columns, and perhaps another number."""
    numbers = {c: pa.array([r[c] for r in rows], pa.int64()) for c in (key, also) if c}
    return pa.table({**numbers, **{n: pa.array([r[n] for r in rows], pa.binary()) for n in names}})


ENTRY = "bucket long, b_h binary, b_c binary, b_doc binary, b_start binary, b_more binary, cell long"
ASK = "cell long, a_h binary, a_c binary"
RUN = "bucket long, r_h binary, r_c binary, r_doc binary, r_start binary, r_count binary, r_data binary"
MARK = "cell long, m_h binary, m_c binary, m_doc binary, m_start binary, m_mask binary"


def _join(table: pa.Table, name: str, width: int) -> np.ndarray:
    cols = [tb.unpack(b, width) for b in table.column(name).to_pylist() if b]
    return np.concatenate(cols) if cols else np.zeros(0, U)


def _entries(spec: Spec, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def cell_entries(table: pa.Table) -> pa.Table:
        t = texts(table, spec)
        r = all_runs(t, spec)
        cell, doc = table.column("cell")[0].as_py(), t.ids[r.row]
        order = np.lexsort((r.start, doc, r.c, r.h))
        h, c, doc, start = r.h[order], r.c[order], doc[order], r.start[order]
        head = _heads(h, c)
        end = np.append(head[1:], len(h)) - 1 if len(h) else head
        more = (end > head) if spec.same else doc[end] != doc[head]
        h, c, doc, start = h[head], c[head], doc[head], start[head] if spec.same else np.zeros(len(head), np.int64)  # only needed for order inside a document
        rows = [{"bucket": int(h[p[0]] % U(buckets)), "cell": cell, "b_h": tb.pack(h[p], 6), "b_c": tb.pack(c[p], 6), "b_doc": tb.pack(doc[p], 8), "b_start": tb.pack(start[p], 5), "b_more": np.packbits(more[p]).tobytes()} for p in _parts((h % U(buckets)).astype(np.int64))]
        return _blob(rows, ["b_h", "b_c", "b_doc", "b_start", "b_more"], "bucket", "cell")

    return cell_entries


def _known(table: pa.Table, spec: Spec) -> tuple[np.ndarray, ...]:
    """Entries of repeated anchors in a bucket, by (h, c, doc, start): h, c, doc, start, more, cell, head of each (h, c)."""
    h, c = _join(table, "b_h", 6), _join(table, "b_c", 6)
    doc, start = _join(table, "b_doc", 8).astype(np.int64), _join(table, "b_start", 5).astype(np.int64)
    sizes = [len(b) // 6 for b in table.column("b_h").to_pylist()]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(table.column("b_more").to_pylist(), sizes)]
    more = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    cell = np.repeat(table.column("cell").to_numpy(), sizes) if sizes else np.zeros(0, np.int64)
    by_h = np.argsort(h, kind="stable")
    head = _heads(h[by_h])
    if len(head):
        d, m = doc[by_h], more[by_h]
        n = np.diff(np.append(head, len(h)))
        again = np.logical_or.reduceat(m, head) | ((n > 1) if spec.same else np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head))
        by_h = by_h[np.repeat(again, n)]
    h, c, doc, start, more, cell = (v[by_h] for v in (h, c, doc, start, more, cell))
    order = np.lexsort((start, doc, c, h))
    h, c, doc, start, more, cell = (v[order] for v in (h, c, doc, start, more, cell))
    return h, c, doc, start, more, cell, _heads(h, c)


def _asks(spec: Spec) -> Callable[[pa.Table], pa.Table]:
    def bucket_asks(table: pa.Table) -> pa.Table:
        h, c, _, _, _, cell, head = _known(table, spec)
        h, c, cell = h[head], c[head], cell[head]
        return _blob([{"cell": int(cell[p[0]]), "a_h": tb.pack(h[p], 6), "a_c": tb.pack(c[p], 6)} for p in _parts(cell)], ["a_h", "a_c"], "cell")

    return bucket_asks


def _find(h: np.ndarray, c: np.ndarray, of_h: np.ndarray, of_c: np.ndarray) -> np.ndarray:
    """For each (h, c) its place among the distinct (of_h, of_c), or -1."""
    if not len(of_h) or not len(h):
        return np.full(len(h), -1)
    key, want = tb.mix(of_h * U(0x9E3779B97F4A7C15) + of_c), tb.mix(h * U(0x9E3779B97F4A7C15) + c)
    order = np.argsort(key)
    at = order[np.minimum(np.searchsorted(key[order], want), len(key) - 1)]
    return np.where((of_h[at] == h) & (of_c[at] == c), at, -1)


def _runs_out(spec: Spec, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cell_runs(docs: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["r_h", "r_c", "r_doc", "r_start", "r_count", "r_data"]
        if not docs.num_rows or not asks.num_rows:
            return _blob([], names, "bucket")
        t = texts(docs, spec)
        r = all_runs(t, spec)
        of_h, of_c = _join(asks, "a_h", 6), _join(asks, "a_c", 6)
        at = _find(r.h, r.c, of_h, of_c)
        keep = np.flatnonzero(at >= 0)
        doc = t.ids[r.row]
        keep = keep[np.lexsort((r.start[keep], doc[keep], at[keep]))]
        keep = keep[_heads(at[keep])]
        values = t.data if t.x is None else t.x
        rows = []
        for p in _parts((r.h[keep] % U(buckets)).astype(np.int64)):
            q = keep[p]
            first = t.bounds[r.row[q]] + r.start[q]
            n = r.count[q] + spec.width - 1
            spots = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            rows.append({"bucket": int(r.h[q[0]] % U(buckets)), "r_h": tb.pack(r.h[q], 6), "r_c": tb.pack(r.c[q], 6), "r_doc": tb.pack(doc[q], 8), "r_start": tb.pack(r.start[q], 5), "r_count": tb.pack(r.count[q], 2), "r_data": values[spots].tobytes()})
        return _blob(rows, names, "bucket")

    return cell_runs


#: verify(elements, bounds of the runs, documents, starts, spec) -> for every window (all windows of a run, run by run) whether it has an earlier occurrence.
Verify = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spec], np.ndarray]


def _marks(spec: Spec, verify: Verify) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def bucket_marks(entries: pa.Table, got: pa.Table) -> pa.Table:
        names = ["m_h", "m_c", "m_doc", "m_start", "m_mask"]
        if not entries.num_rows or not got.num_rows:
            return _blob([], names, "cell")
        rh, rc = _join(got, "r_h", 6), _join(got, "r_c", 6)
        doc, start = _join(got, "r_doc", 8).astype(np.int64), _join(got, "r_start", 5).astype(np.int64)
        count = _join(got, "r_count", 2).astype(np.int64)
        x = np.frombuffer(b"".join(got.column("r_data").to_pylist()), np.uint8 if spec.elements == "bytes" else U)
        bounds = np.concatenate(([0], np.cumsum(count + spec.width - 1)))
        first = np.cumsum(count) - count
        early = np.zeros(int(count.sum()), bool)
        for p in _parts(((rh >> U(12)) % U(max(1, math.ceil(x.nbytes / VERIFY_BYTES)))).astype(np.int64)):
            size = count[p] + spec.width - 1
            spots = np.repeat(bounds[p] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            own = np.repeat(first[p] - np.cumsum(count[p]) + count[p], count[p]) + np.arange(int(count[p].sum()))
            early[own] = verify(x[spots], np.concatenate(([0], np.cumsum(size))), doc[p], start[p], spec)
        bit = np.arange(len(early)) - np.repeat(first, count)
        mask = np.add.reduceat(np.where(early, U(1) << bit.astype(U), U(0)), first) if len(first) else np.zeros(0, U)
        h, c, edoc, estart, more, cell, _ = _known(entries, spec)
        at = _find(h, c, rh, rc)
        own = (edoc == doc[at]) & ((estart == start[at]) | (not spec.same))
        keep = np.flatnonzero((at >= 0) & (~own | more | (mask[at] != 0)))
        at, h, c, cell = at[keep], h[keep], c[keep], cell[keep]
        rows = [{"cell": int(cell[p[0]]), "m_h": tb.pack(h[p], 6), "m_c": tb.pack(c[p], 6), "m_doc": tb.pack(doc[at[p]], 8), "m_start": tb.pack(start[at[p]], 5), "m_mask": tb.pack(mask[at[p]], 8)} for p in _parts(cell)]
        return _blob(rows, names, "cell")

    return bucket_marks


def covered(t: Texts, marks: pa.Table, spec: Spec) -> np.ndarray:
    """For each element whether a repeated window covers it."""
    n = len(t.data) if t.x is None else len(t.x)
    turn = np.zeros(n + 1, np.int32)
    if marks.num_rows:
        mh, mc = _join(marks, "m_h", 6), _join(marks, "m_c", 6)
        mdoc, mstart, mask = _join(marks, "m_doc", 8).astype(np.int64), _join(marks, "m_start", 5).astype(np.int64), _join(marks, "m_mask", 8)
        for r in runs(t, spec):
            at = _find(r.h, r.c, mh, mc)
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            own = (t.ids[r.row[hit]] == mdoc[at]) & ((r.start[hit] == mstart[at]) | (not spec.same))
            first, count = t.bounds[r.row[hit]] + r.start[hit], r.count[hit]
            full = ~own
            np.add.at(turn, first[full], 1)
            np.add.at(turn, first[full] + count[full] + spec.width - 1, -1)
            part = np.flatnonzero(own & (mask[at] != 0))
            for b in range(int(count[part].max()) if len(part) else 0):
                on = first[part][(mask[at[part]] >> U(b)) & U(1) == 1] + b
                np.add.at(turn, on, 1)
                np.add.at(turn, on + spec.width, -1)
    return np.cumsum(turn[:-1]) > 0


def apply_repeats(docs: DataFrame, spec: Spec, verify: Verify, finish: Callable[[pa.Table, Texts, np.ndarray], pa.Table], schema: str, text: str = "text", doc_id: str = "doc_id", cell_bytes: int = CELL_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """finish(rows of a cell, its texts, covered elements) for all cells."""
    if spec.width - spec.k + 1 > 64:
        raise ValueError("windows are too wide: a run may have 64 windows at most (width - k < 64)")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = tables.text_bytes(d)
    cells, buckets = max(1, math.ceil(total / cell_bytes)), max(1, math.ceil(total / bucket_bytes))
    d = d.select(F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell"), "doc_id", "text")
    entries = d.groupBy("cell").applyInArrow(_entries(spec, buckets), ENTRY)
    asks = entries.groupBy("bucket").applyInArrow(_asks(spec), ASK)
    found = d.groupBy("cell").cogroup(asks.groupBy("cell")).applyInArrow(_runs_out(spec, buckets), RUN)
    marks = entries.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_marks(spec, verify), MARK)

    def last(rows: pa.Table, got: pa.Table) -> pa.Table:
        t = texts(rows, spec)
        return finish(rows, t, covered(t, got, spec))

    return d.groupBy("cell").cogroup(marks.groupBy("cell")).applyInArrow(last, schema)
