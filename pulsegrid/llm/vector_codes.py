"""Product codes of vectors: integer k-means for each part, with norm-of-sum bounds.

A row keeps for each part its entry and a lower bound on the distance to every other entry, stamped with the round of the full
scan that gave it. The history of all codebooks is kept, so a bound ages by the net displacement of entries between its stamp
and now (the norm of the sum of their moves), never by moves added up. A part is scanned anew only if the exact distance to
its entry isn't clearly under the aged bound; all distances that decide are integers.

Rounds are narrow maps over cached rows (memory, then disk; lost blocks are computed again from the table) and one aggregate of
sums: parts x entries x components numbers come to the driver and go out with the next round.

Defined results: rows whose vector is null, or holds a null or a non-finite component, are dropped, as are vectors that aren't
as long as the one of the smallest kept id; lengths that parts don't divide and components of 2^14 (2^26 / 4096) or more raise ValueError; fewer kept rows
than entries give smaller codebooks; ids may repeat or be null (last), equal ids are ordered by their vectors; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import released

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels up to which their sums are broadcast; beyond, rows are salted.
LABELS, SALTS = 100_000, 32
LIMIT = 1 << 26


def quantised(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` and q: floor(SCALE * component) as longs."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(*keep, F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e9)), F.lit(1e9)) * SCALE)).alias("q"))


def nearest(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry (ties to the lower index), its squared distance, the distance to the nearest other entry."""
    d = ((q[:, None, :] - book[None]) ** 2).sum(2)
    code = d.argmin(1)
    best = d[np.arange(len(q)), code]
    if len(book) == 1:
        return code, best, np.full(len(q), np.inf)
    d[np.arange(len(q)), code] = np.iinfo(np.int64).max
    return code, best, np.sqrt(d.min(1).astype(float))


def displacement(history: np.ndarray) -> np.ndarray:
    """(stamp, part, entry): how far each other entry has moved at most between a stamp and now, net; history: (rounds, parts, entries, components)."""
    moved = np.sqrt(((history - history[-1]) ** 2).sum(3).astype(float))
    out = np.zeros_like(moved)
    for k in range(moved.shape[2]):
        others = np.delete(moved, k, 2)
        out[:, :, k] = others.max(2) if others.shape[2] else 0.0
    return out


def assign(q: np.ndarray, history: np.ndarray, code: np.ndarray | None, bound: np.ndarray | None, stamp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, bounds, stamps and squared distances (rows, parts) under the last codebook, and how many parts were scanned."""
    now, parts = len(history) - 1, history.shape[1]
    q = q.reshape(len(q), parts, -1)
    first = code is None
    code, bound, stamp = (np.zeros((len(q), parts), np.int8), np.zeros((len(q), parts)), np.zeros((len(q), parts), np.int8)) if first else (code.copy(), bound.copy(), stamp.copy())
    error, scanned, drift = np.zeros((len(q), parts), np.int64), 0, displacement(history)
    for p in range(parts):
        book, x = history[-1, p], q[:, p]
        own = ((x - book[code[:, p]]) ** 2).sum(1)
        error[:, p] = own
        aged = bound[:, p] - drift[stamp[:, p], p, code[:, p]]
        # a margin beyond rounding errors, so that ties are always scanned
        again = np.flatnonzero(np.sqrt(own.astype(float)) * (1 + 1e-9) + 1e-6 >= aged) if not first else np.arange(len(q))
        for a in range(0, len(again), 4096):
            i = again[a : a + 4096]
            code[i, p], error[i, p], bound[i, p] = nearest(x[i], book)
            stamp[i, p] = now
        scanned += len(again)
    return code, bound, stamp, error, scanned


STATE = "q binary, code binary, bound binary, stamp binary, error long, scanned int"


def _step(rows: DataFrame, keep: list[str], history: np.ndarray, width: int) -> DataFrame:
    """One assignment of all rows: those of quantised() at first, those of the last step after."""
    parts = history.shape[1]
    schema = T.StructType([*[rows.schema[k] for k in keep], *T.StructType.fromDDL(STATE)])
    first = "code" not in rows.columns

    def column(a: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(a).reshape(len(a), -1).view(np.uint8).reshape(len(a), -1)
        return pa.array([r.tobytes() for r in raw], pa.binary())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if first:
                q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, width)
                if np.abs(q).max(initial=0) >= LIMIT:
                    raise ValueError(f"components of {LIMIT // SCALE} or more aren't supported")
                code = bound = stamp = None
            else:
                q, code, bound, stamp = (np.frombuffer(b"".join(b.column(c).to_pylist()), t).reshape(b.num_rows, -1) for c, t in (("q", np.int32), ("code", np.int8), ("bound", np.float64), ("stamp", np.int8)))
                q = q.astype(np.int64)
            code, bound, stamp, error, n = assign(q, history, code, bound, stamp)
            scans = np.zeros(b.num_rows, np.int32)
            scans[0] = n
            arrays = [*[b.column(k) for k in keep], column(q.astype(np.int32)), column(code), column(bound), column(stamp), pa.array(error.sum(1), pa.int64()), pa.array(scans, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _moved(state: DataFrame, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The next codebook: floor(sum / count) of each entry's parts; unused entries stay. And the parts that were scanned."""
    parts, entries, size = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scanned = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64), 0
        for b in batches:
            q, code = (np.frombuffer(b"".join(b.column(c).to_pylist()), t).reshape(b.num_rows, parts, -1) for c, t in (("q", np.int32), ("code", np.int8)))
            scanned += sum(b.column("scanned").to_pylist())
            for p in range(parts):
                np.add.at(sums[p], code[:, p, 0], q[:, p].astype(np.int64))
                counts[p] += np.bincount(code[:, p, 0], minlength=entries)
        flat = np.concatenate([sums.reshape(-1), counts.reshape(-1), [scanned]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["at", "v"])

    flat = np.zeros(parts * entries * size + parts * entries + 1, np.int64)
    for at, v in state.select("q", "code", "scanned").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v")).toLocalIterator():
        flat[at] = v
    sums, counts = flat[: book.size].reshape(book.shape), flat[book.size : -1].reshape(parts, entries)
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book), int(flat[-1])


def book_hash(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry, place, decimal and comma-joined."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Coded rows (vec_id, label, code: two hex digits a part, error), the codebooks (part, entry, component), parts scanned in each round."""
    spark = rows.sparkSession
    base = quantised(rows, vector, [vec_id, label])
    start = [r["q"] for r in base.orderBy(F.col(vec_id).asc_nulls_last(), "q").limit(entries).collect()]
    out = T.StructType([T.StructField("vec_id", rows.schema[vec_id].dataType), T.StructField("label", rows.schema[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not start:
        return spark.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64), []
    width = len(start[0])
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    start = [q for q in start if len(q) == width]
    if len(start) < entries:  # some of the smallest ids have other lengths
        start = [r["q"] for r in base.filter(F.size("q") == width).orderBy(F.col(vec_id).asc_nulls_last(), "q").limit(entries).collect()]
    history = np.array(start, np.int64).reshape(1, len(start), parts, -1).transpose(0, 2, 1, 3)
    if np.abs(history).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} or more aren't supported")
    state, scans = base.filter(F.size("q") == width), []
    held: DataFrame | None = None
    for _ in range(rounds):
        state = _step(state, [vec_id, label], history, width).persist(StorageLevel.MEMORY_AND_DISK)
        book, scanned = _moved(state, history[-1])
        scans.append(scanned)
        if held is not None:
            held.unpersist()
        held, history = state, np.concatenate([history, book[None]])
    done = _step(state, [vec_id, label], history, width)
    hexes = F.lower(F.hex("code"))
    return done.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), hexes.alias("code"), "error"), history[-1], scans


def with_label_error(coded: DataFrame, limit: int = LABELS) -> DataFrame:
    """label_error: error summed over equal labels, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_l"))
    if sums.limit(limit + 1).count() <= limit:
        return coded.join(F.broadcast(sums), same).drop("_l")
    salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = coded.withColumn("_m", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return mine.join(salted, same & (F.col("_m") == F.col("_s"))).drop("_l", "_m", "_s")


def digest(rows: DataFrame) -> DataFrame:
    coded, book, _ = encode(rows)
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(book_hash(book)).alias("codebooks_sha256"))
