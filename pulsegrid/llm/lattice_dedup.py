"""Embedding near-dedup by lattice hashing.

Unit vectors are projected to eight dimensions by random matrices, one for each
table, and decoded to the nearest point of the E8 lattice: that point is the
vector's home cell. Neighbouring lattice cells that are nearly as close are
probed too (at most PROBES of the 240, the nearest). Two vectors meet in a
table if the home of one is a home or probe of the other; their cosine is then
checked in double precision, so no link is false. Recall, against brute force
on the test tables, is in README.md.

Equal vectors of a label are one vector with a weight. A cell is compared in
blocks: cells over BLOCK rows are split into pairs of blocks, which are
separate groups, so no cell is one task and none is cut off. Pairs are counted
where they meet first and are never written; tasks emit a count for each vector
and a spanning forest of the links.

Vectors that are null, empty, zero or that hold null or non-finite numbers, and
rows with a null label, link with nothing. Vectors of different length don't
meet. Rows with equal ids are separate vectors; a null id names a component
only if all its ids are null. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .components import components, forest
from .repeats import _heads
from .tables import checkpoint

U = np.uint64
COSINE = 0.98
TABLES, SCALE, GAP, PROBES, SEED = 2, 0.8, 0.3, 7, 11
#: Rows of a block of a cell, rows for each group of cells.
BLOCK, GROUP_ROWS = 2048, 20_000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the better of the nearest points of D8 and of D8 moved by one half."""

    def in_d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        e = y - r
        worst = np.abs(e).argmax(1)[odd]
        r[odd, worst] += np.where(e[odd, worst] >= 0, 1, -1)
        return r

    a, b = in_d8(x), in_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _code(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.copy()
    for k in range(8):
        h = tb.mix(h * U(0x9E3779B97F4A7C15) + np.rint(points[..., k] * 2).astype(np.int64).view(U))
    return h | U(1)  # never 0


def cells(x: np.ndarray, salt: np.ndarray, tables: int = TABLES, scale: float = SCALE, gap: float = GAP, seed: int = SEED) -> np.ndarray:
    """(n, tables, 1 + PROBES) codes of the home cell and the probes of unit vectors; 0 where there are fewer probes."""
    out = np.zeros((len(x), tables, 1 + PROBES), U)
    for t in range(tables):
        y = x @ np.random.default_rng((seed, t, x.shape[1])).normal(size=(x.shape[1], 8)) * scale
        home = nearest_point(y)
        further = 2 - 2 * (y - home) @ ROOTS.T  # squared distance beyond the home's
        near = np.argpartition(further, PROBES, axis=1)[:, :PROBES]
        ok = np.take_along_axis(further, near, 1) <= gap
        s = tb.mix(salt + U(t))
        out[:, t, 0] = _code(home, s)
        out[:, t, 1:] = np.where(ok, _code(home[:, None, :] + ROOTS[near], np.repeat(s[:, None], PROBES, 1)), U(0))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


MEMBER = "cell long, key long, weight long, home boolean, vector binary, codes binary"


def _members(tables: int, scale: float, gap: float, ids_only: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for part in np.array_split(rows, max(1, len(rows) // 2000)):
                    raw = flat[first[part][:, None] + np.arange(dim)]
                    salt = tb.mix(b.column("label").to_numpy()[part].view(U) * U(1_000_003) + U(dim))
                    code = cells(unit(raw.astype(np.float64)), salt, tables, scale, gap)
                    n, t, p = np.nonzero(code)
                    cell = pa.array(code[n, t, p].view(np.int64))
                    if ids_only:
                        yield pa.record_batch([cell], ["cell"])
                        continue
                    take = pa.array(part[n])
                    vec = pa.array([v.tobytes() for v in raw.astype("<f8")], pa.binary()).take(pa.array(n))
                    codes = pa.array([c.tobytes() for c in code], pa.binary()).take(pa.array(n))
                    yield pa.record_batch([cell, b.column("key").take(take), b.column("weight").take(take), pa.array(p == 0), vec, codes], ["cell", "key", "weight", "home", "vector", "codes"])

    return each


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair and table: whether the home of a is in b's cells, and the home of b in a's. a, b: (pairs, tables, cells)."""
    return (b == a[:, :, :1]).any(2), (a == b[:, :, :1]).any(2)


def _compare(cosine: float):
    def group(table: pa.Table) -> pa.Table:
        cell, i, j = table.column("cell").to_numpy(), table.column("i").to_numpy(), table.column("j").to_numpy()
        side = table.column("side").to_numpy()
        key, weight, home = table.column("key").to_numpy(), table.column("weight").to_numpy(), table.column("home").to_numpy()
        vec, codes = table.column("vector").to_pylist(), table.column("codes").to_pylist()
        order = np.lexsort((key, side, j, i, cell))
        head = _heads(cell[order], i[order], j[order])
        ids, counts, ea, eb = [], [], [], []
        for rows in np.split(order, head[1:]):
            if len(rows) < 2:
                continue
            c = U(np.int64(cell[rows[0]]).view(U))
            left = rows[side[rows] == 0]
            right = rows[side[rows] == 1] if i[rows[0]] != j[rows[0]] else left
            if not len(right):
                continue
            x = unit(np.frombuffer(b"".join([vec[r] for r in left]), "<f8").reshape(len(left), -1))
            y = x if right is left else unit(np.frombuffer(b"".join([vec[r] for r in right]), "<f8").reshape(len(right), -1))
            close = x @ y.T >= cosine
            close &= home[left][:, None] | home[right][None, :]
            if right is left:
                close = np.triu(close, 1)
            p, q = np.nonzero(close)
            if not len(p):
                continue
            code = {r: np.frombuffer(codes[r], U) for r in set(left[p].tolist()) | set(right[q].tolist())}
            a, b = left[p], right[q]
            swap = key[a] > key[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            forest_a, forest_b = forest(key[a], key[b])
            ea.append(forest_a)
            eb.append(forest_b)
            for part in np.array_split(np.arange(len(a)), max(1, len(a) // 50_000)):
                ca = np.stack([code[r] for r in a[part].tolist()]).reshape(len(part), -1, 1 + PROBES)
                cb = np.stack([code[r] for r in b[part].tolist()]).reshape(len(part), -1, 1 + PROBES)
                ab, ba = _meet(ca, cb)
                t = (ab | ba).argmax(1)  # the first table where they meet, and there the home of the smaller key if it counts
                n = np.arange(len(part))
                spot = np.where(ab[n, t], ca[n, t, 0], cb[n, t, 0])
                mine = part[spot == c]
                ids += [key[a[mine]], key[b[mine]]]
                counts += [weight[b[mine]], weight[a[mine]]]
        k = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        u, at = np.unique(k, return_inverse=True)
        total = np.bincount(at, n, len(u)).astype(np.int64)
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (ea, eb))
        none = pa.nulls
        return pa.table({"key": pa.concat_arrays([pa.array(u, pa.int64()), none(len(a), pa.int64())]), "n": pa.concat_arrays([pa.array(total), none(len(a), pa.int64())]), "a": pa.concat_arrays([none(len(u), pa.int64()), pa.array(a, pa.int64())]), "b": pa.concat_arrays([none(len(u), pa.int64()), pa.array(b, pa.int64())])})

    return group


def near_dedup(rows: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tables: int = TABLES, scale: float = SCALE, gap: float = GAP, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    all_rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    all_rows = all_rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "embedding")))
    single = all_rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    source = single.select("key", "weight", "label", "embedding")

    in_cell = source.mapInArrow(_members(tables, scale, gap, True), "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = source.mapInArrow(_members(tables, scale, gap, False), MEMBER).join(in_cell, "cell")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "weight", "home", "vector", "codes")
    groups = max(1, math.ceil(rows.count() * tables * 3 / GROUP_ROWS))
    # a cell of one block goes with others into a group; each pair of blocks of a large cell is its own unit of the hash
    placed = placed.withColumn("group", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(groups)))
    found = placed.groupBy("group").applyInArrow(_compare(cosine), "key long, n long, a long, b long")
    found = checkpoint(found)
    links = found.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.filter("a is not null").select("a", "b"))
    named = single.select("key", "least", "weight").join(roots, F.col("key") == F.col("v"), "left").select("key", "least", "weight", F.coalesce("root", "key").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").join(links, "key", "left").select(F.col("key").alias("k"), "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = all_rows.select("vec_id", "key").join(named, F.col("key") == F.col("k"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
