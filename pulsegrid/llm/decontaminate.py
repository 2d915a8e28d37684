"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded slice of documents in one task. Its words that no
benchmark item has can be in no occurrence, and neither can runs of other words
that are shorter than the shortest window; what remains is indexed as symbols.
All windows of the benchmark are searched backwards through wavelet-tree
ranks, occurrences are located by sampled suffix positions, and their spans
are merged for each document.

The windows of the benchmark are made by the executors, in blocks of about
``block_bytes`` of text (by hash of the item; an item that is longer is a block
of its own size), and written below the shared folder. The driver passes one
block after another on, in compact form. A task goes through the blocks of its
pass for each shard, so that up to ``PASS_BLOCKS`` blocks cost one pass over the
documents; a larger benchmark takes more passes, with the spans found so far
written between them. Documents are never shuffled.

Items without words have no window; a null item id counts as
the id "null"; equal windows of several items name all of them; documents
that are null, empty or without words are clean; repeated rows give repeated
rows, null ids stay; extra columns are ignored; a document longer than a shard
is a shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import tables, textblock as tb
from .fm_index import FMIndex

WIDTH = 10
BLOCK_BYTES = 8 << 20
#: Blocks of one pass over the documents, all held by each Python worker.
PASS_BLOCKS = 4
#: Text bytes of a shard.
SHARD_BYTES = 16 << 20
ALNUM = tb.is_word("alnum")


@dataclass
class Windows:
    """The distinct windows of a block: symbols[start : start + length] each, with the items item[bounds[k] : bounds[k + 1]]."""

    vocabulary: np.ndarray  # sorted hashes of the block's words
    symbols: np.ndarray  # of all words of the block, from 1
    start: np.ndarray
    length: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    names: list[str]

    def patterns(self) -> np.ndarray:
        """A row of symbols for each window, filled up on the left with 0."""
        width = int(self.length.max())
        at = self.start[:, None].astype(np.int64) + np.arange(width) - (width - self.length[:, None])
        return np.where(at >= self.start[:, None], self.symbols[np.maximum(at, 0)], 0).astype(np.int64)

    def items(self, k: int) -> list[str]:
        return [self.names[i] for i in self.item[self.bounds[k] : self.bounds[k + 1]]]


def windows(names: pa.Array, texts: pa.Array, width: int) -> Windows:
    data, offs = tb.buffers(texts)
    s, _, h = tb.words(data, offs, ALNUM, True)
    ends = np.searchsorted(s, offs)
    vocabulary, symbols = np.unique(h, return_inverse=True)
    size = np.diff(ends)
    n = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), n)
    start = np.repeat(ends[:-1] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    every = Windows(vocabulary, symbols + 1, start, np.minimum(size[item], width), np.zeros(0), item, names.to_pylist())
    if not len(start):
        every.bounds = np.zeros(1, np.int64)
        return every
    rows = every.patterns().astype(np.int32)
    order = np.lexsort(rows.T)
    new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1))
    first = order[new]
    held = np.unique(np.stack([np.cumsum(new) - 1, item[order]]), axis=1)
    return Windows(vocabulary, every.symbols, start[first], every.length[first], np.searchsorted(held[0], np.arange(len(first) + 1)), held[1], every.names)


#: Columns of a block, the arrays as bytes.
ARRAYS = {"vocabulary": np.uint64, "symbols": np.int32, "start": np.int32, "length": np.int32, "bounds": np.int32, "item": np.int32}
BLOCK = ", ".join(["block int", *[f"{c} binary" for c in ARRAYS], "names array<string>"])


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, width: int, block_bytes: int) -> tuple[DataFrame, int]:
    """A row for each block of windows, written below the shared folder, and the number of blocks."""
    n = max(1, -(-tables.text_bytes(benchmark, item_text) // block_bytes))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).distinct()

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        w = windows(group.column("i"), group.column("t").combine_chunks(), width)
        arrays = [pa.array([np.ascontiguousarray(getattr(w, c), kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *arrays, pa.array([w.names], pa.list_(pa.string()))], ["block", *ARRAYS, "names"])

    built = items.select(F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int").alias("block"), "i", "t").groupBy("block").applyInArrow(build, BLOCK)
    return tables.checkpoint(built), n


def _sent(built: DataFrame, blocks: range) -> list:
    """Broadcasts of some blocks; the driver holds one block at a time."""
    out = []
    for b in blocks:
        for r in built.filter(F.col("block") == b).collect():
            out.append(built.sparkSession.sparkContext.broadcast(Windows(*[np.frombuffer(r[c], kind) for c, kind in ARRAYS.items()], list(r["names"]))))
    return out


def search_shard(h: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """Words that occurrences cover, and the items of each document."""
    hit, items = np.zeros(len(h), bool), [set() for _ in range(len(bounds) - 1)]
    if not len(w.length) or not len(h):
        return hit, items
    at = np.minimum(np.searchsorted(w.vocabulary, h), len(w.vocabulary) - 1)
    known = w.vocabulary[at] == h
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    edges = np.flatnonzero(edge)
    size = np.diff(edges)
    good = known[edges[:-1]] & (size >= w.length.min())
    first, size = edges[:-1][good], size[good]
    if not len(first):
        return hit, items
    # the kept runs, each followed by a 0
    spots = np.repeat(first - np.cumsum(size + 1) + size + 1, size + 1) + np.arange(int((size + 1).sum()))
    gap = np.cumsum(size + 1) - 1
    spots[gap] = 0
    x = at[spots] + 1
    x[gap] = 0
    index = FMIndex(x, len(w.vocabulary))
    lo, hi = index.search(w.patterns())
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    word = spots[index.locate(rows)]
    turn = np.zeros(len(h) + 1, np.int32)
    np.add.at(turn, word, 1)
    np.add.at(turn, word + w.length[which], -1)
    pairs = np.unique(np.stack([doc[word], which]), axis=1) if len(word) else np.zeros((2, 0), np.int64)
    for d, p in pairs.T.tolist():
        items[d].update(w.items(p))
    return np.cumsum(turn[:-1]) > 0, items


def _runs(hit: np.ndarray) -> np.ndarray:
    """First word and end of each run."""
    on = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(on == 1), np.flatnonzero(on == -1)], 1)


def _shards(data: np.ndarray, offs: np.ndarray, blocks: list, old: list) -> Iterator[tuple]:
    """For each shard of a batch: its rows, starts and ends of words in data, the rows' bounds in words, covered words, items of each row."""
    for i, j, a, _ in tb.slices(offs, 0, SHARD_BYTES):
        if a != offs[i]:  # the rest of a longer document, which is a shard of its own
            continue
        s, e, h = tb.words(data[a : int(offs[j])], offs[i : j + 1] - a, ALNUM, True)
        bounds = np.searchsorted(s, offs[i : j + 1] - a)
        hit, items = np.zeros(len(h), bool), [set() for _ in range(j - i)]
        for w in blocks:
            more, names = search_shard(h, bounds, w.value)
            hit |= more
            for mine, found in zip(items, names):
                mine |= found
        for k in range(j - i):
            for p, q in zip(old[i + k][::2], old[i + k][1::2]):
                hit[bounds[k] + p : bounds[k] + q] = True
        yield i, j, s + a, e + a, bounds, hit, items


SCHEMA = "doc_id long, text string, n_words long, spans array<long>, items array<string>"


def _marked(blocks: list):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, offs = tb.buffers(x.column("text"))
            old = [v or [] for v in x.column("spans").to_pylist()]
            for i, j, _, _, bounds, hit, items in _shards(data, offs, blocks, old):
                part = x.slice(i, j - i)
                spans = [_runs(hit[p:q]).ravel().tolist() for p, q in zip(bounds[:-1], bounds[1:])]
                names = [sorted(new | set(had or [])) for new, had in zip(items, part.column("items").to_pylist())]
                yield pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(np.diff(bounds), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

    return task


def _passes(n: int) -> list[range]:
    return [range(b, min(n, b + PASS_BLOCKS)) for b in range(0, n, PASS_BLOCKS)]


def _between(out: DataFrame, sent: list) -> DataFrame:
    """The rows after a pass that others follow: written, so that neither the plan nor the broadcasts grow."""
    out = tables.checkpoint(out)
    for w in sent:
        w.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, n_words, spans (first, end, ... in words) and items of every row of docs."""
    tables.bounded_batches(docs.sparkSession)
    built, n = blocks_of(benchmark, item_id, item_text, width, block_bytes)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for blocks in _passes(n):
        sent = _sent(built, blocks)
        out = out.mapInArrow(tables.released(_marked(sent)), SCHEMA)
        if blocks[-1] < n - 1:
            out = _between(out, sent)
    return out


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            spans, items = x.column("spans").to_pylist(), x.column("items").to_pylist()
            n = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.record_batch([x.column("doc_id"), x.column("n_words"), pa.array(n, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]), pa.array([k > 0 for k in n])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(each, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without the words of benchmark windows (from the first to the last of each span); n_chars follows the text, clean rows stay as they are.

    Each pass adds its spans to those of the passes before it; the text is cut once, in the last one.
    """
    cols, kinds, (marks,) = docs.columns, docs.schema, tables.unused(docs, "__pg_spans")
    tables.bounded_batches(docs.sparkSession)
    built, n = blocks_of(benchmark, options.get("item_id", "item_id"), options.get("item_text", "text"), options.get("width", WIDTH), options.get("block_bytes", BLOCK_BYTES))
    marked = StructType([*kinds.fields, StructField(marks, ArrayType(LongType()))])

    def cut(sent: list, first: bool, last: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                data, offs = tb.buffers(x.column(text))
                old = [[]] * x.num_rows if first else [v or [] for v in x.column(marks).to_pylist()]
                spans, new = list(old), {}
                for i, j, s, e, bounds, hit, _ in _shards(data, offs, sent, old):
                    for k in np.unique(np.searchsorted(bounds, np.flatnonzero(hit), "right") - 1).tolist():
                        p, row = bounds[k], i + k
                        runs = _runs(hit[p : bounds[k + 1]])
                        spans[row] = runs.ravel().tolist()
                        keep = np.ones(int(offs[row + 1] - offs[row]), bool)
                        for f, l in runs:
                            keep[s[p + f] - offs[row] : e[p + l - 1] - offs[row]] = False
                        if last:
                            new[row] = data[offs[row] : offs[row + 1]][keep].tobytes().decode("utf-8")
                arrays = {c: x.column(c) for c in cols}
                if not last:
                    yield pa.record_batch([*arrays.values(), pa.array(spans, pa.list_(pa.int64()))], [*cols, marks])
                    continue
                if new:
                    texts = x.column(text).to_pylist()
                    for k, v in new.items():
                        texts[k] = v
                    arrays[text] = pa.array(texts, x.column(text).type)
                    if "n_chars" in arrays and pa.types.is_integer(arrays["n_chars"].type):
                        chars = arrays["n_chars"].to_pylist()
                        for k, v in new.items():
                            chars[k] = len(v)
                        arrays["n_chars"] = pa.array(chars, x.column("n_chars").type)
                yield pa.record_batch([arrays[c] for c in cols], cols)

        return task

    out = docs
    for blocks in _passes(n):
        first, last = blocks[0] == 0, blocks[-1] == n - 1
        sent = _sent(built, blocks)
        out = out.mapInArrow(tables.released(cut(sent, first, last)), kinds if last else marked)
        if not last:
            out = _between(out, sent)
    return out
