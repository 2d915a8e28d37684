"""Repair of conversations' structure: faults, the cheapest edits to system? (user assistant)+, repaired rows.

A conversation's rows are taken by turn (nulls first); rows of one turn by the md5 of role and text, so a repeated row stands
beside its first. Sequences of role/fault symbols are cut into pieces; a task takes many conversations, shares one Re-Pair
grammar and its matrices among them (audit_grammar) and walks each conversation piece by piece. Only numbers, hashes and
symbols are sorted; texts move when edits go back to the rows and when repaired rows are put in order.

Defined results: nulls in conv_id, turn, role or text count as one space (a null conv_id is one conversation, and stays null in
results); roles count by their initial; extra columns are ignored; an empty table gives no rows; a conversation of any length
is many rows of many tasks until its audit, one string, is put together. Input has to come from a table or a checkpoint (row
numbers are taken twice).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import audit_grammar as G
from .tables import bounded_batches, checkpoint, released

#: Rows of a piece, pieces that share a grammar, characters of a segment that is hashed later.
PIECE, BLOCK, SEGMENT = 512, 20_000, 1 << 20
NONSPACE = r"[^\x20\x09-\x0D]"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (no nulls in the last two) after damage by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's."""
    hit = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    times = F.when(hit == 0, F.array().cast("array<int>")).when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(_spaced("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), F.monotonically_increasing_id().alias("rid"))


def diagnosed(rows: DataFrame) -> DataFrame:
    """Of each row: conv_id, turn, rid, h (the order within a turn), role class 0 to 3 (s, u, a, other), fault 0 to 3 (none, blank, duplicate, truncated)."""
    t = F.col("text")
    last = F.regexp_extract(t, rf"({NONSPACE})[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    h = F.md5(F.concat("role", F.lit(":"), t).cast("binary"))
    blank = last == ""
    base = _numbered(rows).select("conv_id", "turn", "rid", h.alias("h"), kind.alias("kind"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    # only keys that occur twice are joined; their rows are the large side, which adaptive execution splits
    again = base.groupBy("conv_id", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "rid")).alias("first")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), "first")
    both = base.join(again, base.conv_id.eqNullSafe(F.col("_c")) & (base.h == F.col("_h")), "left")
    seen = F.col("first").isNotNull() & ~F.struct("turn", "rid").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), 1).when(seen, 2).when(F.col("cut"), 3).otherwise(0)
    return both.select("conv_id", "turn", "rid", "h", (F.col("kind") * 4 + fault).cast("int").alias("sign"))


def _pieces(rows: DataFrame) -> DataFrame:
    """Runs of up to PIECE rows of one conversation, in order: conv_id, piece (a number that grows), signs (a letter a row), rids, first and last turn, distinct turns."""
    key = ["conv_id", "turn", "h", "rid"]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", F.col("turn").cast("long"), "rid", "sign", F.spark_partition_id().cast("long"))
    fields = T.StructType.fromDDL("piece long, signs string, rids array<long>, first long, last long, turns long")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key_, no = None, None, 0
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal no
            if held:
                turns = [t for t, *_ in held if t is not None]
                out.append((key_, (held[0][3] << 28) + no, "".join(chr(65 + s) for _, _, s, _ in held), [r for _, r, _, _ in held], turns[0] if turns else None, turns[-1] if turns else None, len(set(turns))))
                no += 1
                held.clear()

        def batch() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.fieldNames())
            out.clear()
            return made

        for b in batches:
            kind = b.schema.field(0).type
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (conv_id != key_ or len(held) >= PIECE):
                    close()
                key_ = conv_id
                held.append(row)
            if len(out) >= 2000:
                yield batch()
        close()
        if out:
            yield batch()

    return ordered.mapInArrow(run, schema)


def _symbol(sign: int) -> int:
    """What the automaton needs of a row: 0 to delete, else role class and truncation."""
    kind, fault = divmod(sign, 4)
    return 0 if fault in (1, 2) else 1 + 2 * kind + (fault == 3)


_SYMBOL = {chr(65 + s): _symbol(s) for s in range(16)}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Walk:
    """One conversation, piece by piece: the four cheapest audits so far, with the piece's part of each, and counts."""

    def __init__(self) -> None:
        self.row, self.back, self.counts, self.before, self.last, self.first = list(G.START), [], dict.fromkeys(COUNTS, 0), None, None, None
        self.turns = 0

    def take(self, piece: int, signs: str, first: int | None, last: int | None, turns: int, tables: list[G.Matrix], seq: list[int]) -> None:
        parts: list[list[G.Cell | None]] = [[(0, G.EMPTY) if i == j else None for j in range(4)] for i in range(4)]
        live = [i for i in range(4) if self.row[i] is not None]
        for i in live:
            v = parts[i]
            for s in seq:
                v = G.through(v, tables[s])
            parts[i] = v
        best, come = [None] * 4, [None] * 4
        for i in live:
            for k, cell in enumerate(parts[i]):
                if cell is not None:
                    whole = (self.row[i][0] + cell[0], self.row[i][1] + cell[1])
                    if G.better(best[k], whole) is whole:
                        best[k], come[k] = whole, (i, cell[1])
        self.row = best
        self.back.append((piece, come))
        c = self.counts
        for s in signs:
            kind, fault = divmod(ord(s) - 65, 4)
            if fault:
                c[("blank", "duplicate", "truncated")[fault - 1]] += 1
            if self.before is not None and (self.before, kind) not in _LEGAL:
                c["illegal"] += 1
            self.before = kind
        if first is not None:
            self.turns += turns - (first == self.last)
            self.first, self.last = first if self.first is None else self.first, last

    def end(self) -> Iterator[tuple]:
        """(piece, its letters, the state before it), the last piece first; then counts and audit are whole."""
        cost, audit = G.finish(self.row)
        self.counts["cost"], self.audit = cost, str(audit)
        self.counts["gaps"] = int(self.last - self.first + 1 - self.turns) if self.first is not None else 0
        ends = [(self.row[i][0] + G.INSERTS[i][j][0], self.row[i][1] + G.INSERTS[i][j][1], i, G.INSERTS[i][j][1]) for i in range(4) for j in (0, 3) if self.row[i] is not None and G.INSERTS[i][j] is not None]
        state, tail = next((i, str(t)) for c, a, i, t in ends if c == cost and a.n == audit.n and a.h == audit.h)
        for piece, come in reversed(self.back):
            state, part = come[state]
            yield piece, str(part) + tail, state
            tail = ""


def _walked(pieces: DataFrame) -> DataFrame:
    """For each piece its letters and the state before it; on a conversation's last piece its counts and audit."""
    conv = pieces.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("piece long, letters string, state int, audit string, " + ", ".join(f"{c} long" for c in COUNTS))])
    ordered = pieces.select("conv_id", "piece", "signs", "first", "last", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, key, kind = None, None, None

        def ended() -> list[tuple]:
            rows = list(walk.end())
            tail = (walk.audit, *(walk.counts[c] for c in COUNTS))
            return [(key, *r, *(tail if n == 0 else (None,) * len(tail))) for n, r in enumerate(rows)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * len(COUNTS)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.fieldNames())

        for b in batches:
            kind = b.schema.field("conv_id").type
            for at in range(0, b.num_rows, BLOCK):
                block = list(zip(*(c.to_pylist() for c in b.slice(at, BLOCK).columns)))
                distinct = list(dict.fromkeys(r[2] for r in block))
                rules, seqs = G.grammar([[_SYMBOL[s] for s in d] for d in distinct])
                tables, short, out = G.matrices(rules), dict(zip(distinct, seqs)), []
                for conv_id, piece, signs, first, last, turns in block:
                    if walk is None or conv_id != key:
                        if walk is not None:
                            out += ended()
                        walk, key = _Walk(), conv_id
                    walk.take(piece, signs, first, last, turns, tables, short[signs])
                if out:
                    yield batch(out)
        if walk is not None:
            yield batch(ended())

    return ordered.mapInArrow(run, schema)


def _edits(pieces: DataFrame, walked: DataFrame) -> DataFrame:
    """For each row: rid, ord (its place), before and after (roles inserted), role (null: deleted; empty: its own), edit."""
    both = walked.select("piece", "letters", "state").join(pieces.select("piece", "signs", "rids"), "piece").select("piece", "letters", "state", "signs", "rids")
    schema = T.StructType.fromDDL("rid long, ord long, before array<string>, role string, edit string, after array<string>")
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows: list[list] = []
                for piece, letters, state, signs, rids in zip(*(c.to_pylist() for c in b.slice(at, 500).columns)):
                    k, before = 0, []
                    for e in letters:
                        role = "assistant" if state in G.ASSISTANT else "user"
                        if e == "I":
                            before.append(role)
                        else:
                            rows.append([rids[k], piece * PIECE + k, before, None if e == "D" else "" if e == "K" else role, e, []])
                            before = []
                        if e in "IR":
                            state = 3 if state in G.ASSISTANT else 2
                        elif e == "K":
                            state = (ord(signs[k]) - 65) // 4 + 1
                        k += e != "I"
                    if before:
                        rows[-1][5] = before
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema.fieldNames())

    return both.mapInArrow(run, schema)


@dataclass
class Repair:
    """summary: conv_id, counts, cost, audit of each conversation that has rows; lines: conv_id, ord, lines (role, text, edit: the rows that stand where one was)."""

    summary: DataFrame
    lines: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: conv_id, ord, n (within ord), role, text, edit (K, R or I)."""
        return self.lines.select("conv_id", "ord", F.posexplode("lines").alias("n", "_l")).select("conv_id", "ord", "n", "_l.*")


def repair(rows: DataFrame) -> Repair:
    """Diagnose and repair conversations (conv_id, turn, role, text)."""
    pieces = checkpoint(_pieces(diagnosed(rows)))
    walked = checkpoint(_walked(pieces))
    new = lambda names: F.transform(names, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.struct(F.when(F.col("e.role") == "", F.col("r.role")).otherwise(F.col("e.role")).alias("role"), F.col("r.text").alias("text"), F.col("e.edit").alias("edit"))
    kept = F.when(F.col("e.role").isNull(), F.filter(F.array(own), lambda x: F.lit(False))).otherwise(F.array(own))
    both = _numbered(rows).alias("r").join(_edits(pieces, walked).alias("e"), F.col("r.rid") == F.col("e.rid"))
    lines = both.select("r.conv_id", "e.ord", F.concat(new(F.col("e.before")), kept, new(F.col("e.after"))).alias("lines"))
    return Repair(walked.filter("audit is not null").select("conv_id", *COUNTS, "audit"), lines)


def hashes(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of role:text of the rows in order, joined by newlines.

    Short conversations inside a sorted partition are hashed there; what is long or at a partition's edge becomes segments of
    about SEGMENT characters, which one task a conversation streams through the hash (SHA-256 is serial by definition).
    """
    bounded_batches(lines.sparkSession)
    said = F.concat_ws("\n", F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])))
    ordered = lines.select("conv_id", "ord", F.when(F.size("lines") > 0, said).alias("said")).repartitionByRange("conv_id", "ord").sortWithinPartitions("conv_id", "ord")
    conv = lines.schema["conv_id"].dataType
    segments = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("ord long, said string, sha string")])

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, first, size, edge = None, None, None, 0, True
        held: list[str] = []
        out: list[tuple] = []

        def flush(whole: bool) -> None:
            nonlocal held, size, first
            text = "\n".join(held) if held else None
            if whole:
                out.append((key, first, None, hashlib.sha256((text or "").encode()).hexdigest()))
            else:
                out.append((key, first, text, None))
            held, size, first = [], 0, None

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, pa.int64(), pa.string(), pa.string()])], segments.fieldNames())
            out.clear()
            return made

        started = False
        for b in batches:
            kind = b.schema.field(0).type
            for conv_id, at, text in zip(*(c.to_pylist() for c in b.columns)):
                if started and conv_id != key:
                    if first is not None:
                        flush(not edge)
                    edge = False
                if first is None:
                    first = at
                started, key = True, conv_id
                if text is not None:
                    held.append(text)
                    size += len(text)
                if size >= SEGMENT:
                    flush(False)
                    edge = True
            if out:
                yield batch()
        if first is not None:
            flush(False)
            yield batch()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, h, any_ = None, None, None, False
        out: list[tuple] = []
        for b in batches:
            kind = b.schema.field(0).type
            for conv_id, _, text, sha in zip(*(c.to_pylist() for c in b.columns)):
                if h is not None and conv_id != key:
                    out.append((key, h.hexdigest()))
                    h = None
                key = conv_id
                if sha is not None:
                    out.append((key, sha))
                    continue
                if h is None:
                    h, any_ = hashlib.sha256(), False
                if text is not None:
                    h.update(("\n" if any_ else "").encode() + text.encode())
                    any_ = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, pa.string()])], ["conv_id", "repaired_sha256"])
                out.clear()
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])

    parts = ordered.mapInArrow(cut, segments).repartition("conv_id").sortWithinPartitions("conv_id", "ord")
    return parts.mapInArrow(joined, T.StructType([T.StructField("conv_id", conv), T.StructField("repaired_sha256", T.StringType())]))


def digest(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for each conversation of the original rows: counts, cost, audit, hash of the repaired rows."""
    done = repair(damaged)
    all_ = conversations.select("conv_id").distinct().alias("a")
    s, h = done.summary.alias("s"), hashes(done.lines).alias("h")
    both = all_.join(s, F.col("a.conv_id").eqNullSafe(F.col("s.conv_id")), "left").join(h, F.col("a.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    return both.select("a.conv_id", *[F.coalesce(F.col(f"s.{c}"), F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
