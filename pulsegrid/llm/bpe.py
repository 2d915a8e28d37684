"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding: texts are split by the tokenizer's pattern; the distinct pieces of a
partition become rows (piece, position, token); a recursive query joins
neighbouring tokens with the merge table and contracts each piece's leftmost
pair of minimum rank until no piece has a pair left. A piece that is a token as
a whole takes it at once. Decoding joins token rows with the vocabulary; the
bytes are put together in order of position. What comes of the vocabulary file
alone is made once in a worker.

Pieces over LONG bytes contract, in a round, every pair whose rank is the least
within the longest token's length around it: no token that grows elsewhere can
reach it before, so the tokens are the same, and rounds don't grow with the
piece. Equal pairs there go at once (neighbouring ones every second, from the
left); but where the piece holds a token that could come of theirs at a smaller
rank, only the leftmost goes.

Null and empty texts have no tokens; special tokens are ordinary text; repeated
rows give repeated rows; extra columns are ignored; an empty table gives no
rows; null ids stay null. Texts are taken in slices of about a million
characters, a longer text alone. The pieces that a task remembers and the bytes
of one query are bounded; one piece of a text is never cut. The vocabulary file's path is
a parameter that every worker can read; a fixed file, never copied.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

LONG = 128
#: Bytes of the pieces in one encoding query (a longer piece is alone), pieces that a task remembers, tokens in one decoding query.
PIECE_BYTES, REMEMBERED, TOKENS = 400_000, 400_000, 400_000

# k is the row's piece and position in it (piece << 32 | position), b the least (rank << 32 | position) of a piece.
STEP = """
with recursive step(k, t, live) as (
  select k, t, true from piece_bytes
  union all
  (with pairs as (
     select s.k, s.t, s.before, m.id
     from (select k, t, lead(t) over o as next, lead(k) over o as after, lag(k) over o as before from step where live window o as (order by k)) s
     left join merges m on m.pair = s.t::bigint << 16 | s.next and s.k >> 32 = s.after >> 32),
   best as (select k >> 32 as w, min(id::bigint << 32 | (k & 4294967295)) as b from pairs where id is not null group by 1),
   pick as (select w, w << 32 | (b & 4294967295) as spot, (b >> 32)::int as id from best)
   select q.k, case when q.k = spot then b.id else q.t end, spot is not null
   from pairs q left join pick b on q.k >> 32 = b.w
   where spot is null or q.before is distinct from spot)
)
select k, t from step where not live order by k
"""
STEP_LONG = """
with recursive step(k, t, live) as (
  select k, t, true from piece_bytes
  union all
  (with pairs as (
     select s.k, s.t, m.id
     from (select k, t, lead(t) over o as next, lead(k) over o as after from step where live window o as (order by k)) s
     left join merges m on m.pair = s.t::bigint << 16 | s.next and s.k >> 32 = s.after >> 32),
   near as (select *, min(id::bigint << 32 | (k & 4294967295)) over (partition by k >> 32 order by k range between {longest} preceding and 2 * {longest} following) as b, max(id) over (partition by k >> 32) as any_id from pairs),
   hits as (
     select n.k, t, n.id, any_id, coalesce(n.id = b >> 32 and (r.id is null or n.k & 4294967295 = b & 4294967295), false) as hit
     from near n left join risky r on r.w = n.k >> 32 and r.id = n.id),
   marked as (select *, row_number() over (partition by k >> 32 order by k) - row_number() over (partition by k >> 32, id order by k) as run from hits),
   chosen as (select k, t, id, any_id, bool_and(hit) over o and row_number() over o % 2 = 1 as takes from marked window o as (partition by k >> 32, id, run order by k)),
   after_ as (select *, lag(takes) over (partition by k >> 32 order by k) as taken from chosen)
   select k, case when takes then id else t end, any_id is not null from after_ where taken is not true)
)
select k, t from step where not live order by k
"""
DECODE = "select x.p, v.b from token_rows x join vocabulary v on v.id = x.id"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], pa.Table, list[tuple[int, bytes]]]:
    """Ranks, merge table, and tokens that may merge further at a smaller rank than their own with the bytes that come of it."""
    ranks = read_ranks(path)
    cuts = [(l, r, i) for t, i in ranks.items() for k in range(1, len(t)) if (l := ranks.get(t[:k])) is not None and (r := ranks.get(t[k:])) is not None]
    l, r, i = (np.array(x, np.int64) for x in zip(*cuts))
    early = [(m, t) for t, n in ranks.items() for k in range(1, len(t)) for m in (ranks.get(t[:k]), ranks.get(t[k:])) if m is not None and m > n]
    return ranks, pa.table({"pair": l << 16 | r, "id": i.astype(np.int32)}), early


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern).findall
        self.ranks, merges, self.early = _vocabulary(path)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.step_long = STEP_LONG.format(longest=max(map(len, self.ranks)))
        self._create("merges", merges)
        self._create("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "b": pa.array(list(self.ranks), pa.binary())}))
        self.byte_token = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def _create(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"create table {name} as select * from given")
        self.con.unregister("given")

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.count, self.first, self.flat, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _contract(self, pieces: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens in each piece, and all tokens one after the other."""
        n = np.array([len(b) for b in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        self.con.register("piece_bytes", pa.table({"k": np.repeat(np.arange(len(pieces)) << 32, n) | place, "t": self.byte_token[data]}))
        if sql is self.step_long:
            risky = [(w, m) for w, b in enumerate(pieces) for m in {m for m, t in self.early if t in b}]
            self.con.register("risky", pa.table({"w": pa.array([w for w, _ in risky], pa.int64()), "id": pa.array([m for _, m in risky], pa.int32())}))
        got = self.con.sql(sql).to_arrow_table()
        self.con.unregister("piece_bytes")
        return np.bincount(got.column("k").to_numpy() >> 32, minlength=len(pieces)), got.column("t").to_numpy().astype(np.uint32)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that have no number yet."""
        base = len(self.number)
        raw = [p.encode() for p in pieces]
        n, first = np.ones(len(pieces), np.int32), np.zeros(len(pieces), np.int64)
        whole: list[int] = []
        parts: list[np.ndarray] = []
        todo: dict[str, list[int]] = {STEP: [], self.step_long: []}
        at: list[int] = []
        for i, b in enumerate(raw):
            if (t := self.ranks.get(b)) is not None:
                at.append(i)
                whole.append(t)
            else:
                todo[STEP if len(b) <= LONG else self.step_long].append(i)
        first[at] = np.arange(len(at))
        parts.append(np.array(whole, np.uint32))
        size = len(at)
        for sql, which in todo.items():
            if which:
                n[which], flat = self._contract([raw[i] for i in which], sql)
                first[which] = size + np.cumsum(n[which]) - n[which]
                parts.append(flat)
                size += len(flat)
        flat = np.concatenate(parts)
        while len(self.count) < base + len(n):
            self.count, self.first = np.resize(self.count, 2 * len(self.count)), np.resize(self.first, 2 * len(self.first))
        while len(self.flat) < self.size + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.count[base : base + len(n)] = n
        self.first[base : base + len(n)] = self.size + first
        self.flat[self.size : self.size + len(flat)] = flat
        self.size += len(flat)
        self.number.update(zip(pieces, range(base, base + len(pieces))))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text, as uint32."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        if len(self.number) > REMEMBERED:
            self.forget()
        split = [self.split(t) for t in texts]
        part, size = [], 0
        for p in set().union(*split).difference(self.number):
            if part and size + len(p.encode()) > PIECE_BYTES:
                self.learn(part)
                part, size = [], 0
            part.append(p)
            size += len(p.encode())
        if part:
            self.learn(part)
        for s in split:
            w = np.fromiter(map(self.number.__getitem__, s), np.int64, len(s))
            n = self.count[w]
            out.append(self.flat[np.repeat(self.first[w] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        return out

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence; sequences share a query up to TOKENS tokens, longer ones are decoded in pieces."""
        out: list[list[bytes]] = [[] for _ in ids]
        rows: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not rows:
                return
            flat = np.concatenate([x for _, x in rows]).astype(np.int32)
            self.con.register("token_rows", pa.table({"p": np.arange(len(flat), dtype=np.int32), "id": flat}))
            got = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("token_rows")
            if got.num_rows != len(flat):
                raise ValueError("a token id isn't in the vocabulary")
            p, b = got.column("p").to_numpy(), got.column("b").cast(pa.large_binary()).combine_chunks()
            if (p[1:] < p[:-1]).any():
                b = b.take(pa.array(np.argsort(p)))
            ends = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
            data = memoryview(b.buffers()[2]) if b.buffers()[2] is not None else memoryview(b"")
            at = ends[np.cumsum([0, *(len(x) for _, x in rows)])].tolist()
            for k, (i, _) in enumerate(rows):
                out[i].append(bytes(data[at[k] : at[k + 1]]))
            rows.clear()

        size = 0
        for i, x in enumerate(ids):
            for a in range(0, len(x), TOKENS):
                part = x[a : a + TOKENS]
                if size + len(part) > TOKENS:
                    flush()
                    size = 0
                rows.append((i, part))
                size += len(part)
        flush()
        return [b"".join(x) for x in out]


def _slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        if part and size + len(t or "") > limit:
            yield at, part
            at, size, part = i, 0, []
        part.append(t or "")
        size += len(t or "")
    if part:
        yield at, part


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for x in batches:
            for at, part in _slices(x.column(1).to_pylist()):
                ids = codec.encode_all(part)
                yield pa.record_batch([x.column(0).slice(at, len(part)), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    tables.bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(tables.released(each), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of every row of doc_id, ids; null ids give no bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for x in batches:
            ids = [np.array(i or [], np.int32) for i in x.column(1).to_pylist()]
            yield pa.record_batch([x.column(0), pa.array(codec.decode_all(ids), pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(tables.released(each), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the bytes they decode to, without moving either."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for x in batches:
            for at, part in _slices(x.column(1).to_pylist()):
                ids = codec.encode_all(part)
                back = codec.decode_all(ids)
                yield pa.record_batch([x.column(0).slice(at, len(part)), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(b).hexdigest() for b in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tables.bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(tables.released(each), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 of every row, after a check that the ids decode to the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for x in batches:
            for at, part in _slices(x.column(1).to_pylist()):
                ids = codec.encode_all(part)
                if codec.decode_all(ids) != [t.encode() for t in part]:
                    raise ValueError("token ids don't decode to their text")
                yield pa.record_batch([x.column(0).slice(at, len(part)), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids])], ["doc_id", "ids", "n_tokens", "ids_sha256"])

    tables.bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(tables.released(each), "doc_id long, ids array<int>, n_tokens long, ids_sha256 string")
