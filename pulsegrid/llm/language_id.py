"""Language ID by a bidirectional gated recurrent network over bytes.

Training: windows of bytes from a bounded sample of the distinct texts of every
label (some places of many texts teach more than all of a few), numpy,
backpropagation through time, Adam; every position is labelled with its text's
language. Prediction: whole texts, cut into segments that run side by side from
zero states, both directions; each position gets probabilities and a text's
probabilities are their mean. The label column is never an input.

Null texts, and texts without a letter, are ``und`` with score 0; empty texts
too. Rows with a null label aren't learned from. Repeated rows give repeated
rows; with no labelled row at all every text is ``und``; of equal probabilities
the label that sorts first wins; very long texts are read whole, segment by
segment; an empty table gives no rows; extra columns are ignored. A null doc_id counts as the empty text in the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

#: Bounds of the training sample: texts for each language (about), windows of each text, bytes of a window.
TEXTS, WINDOWS, SPAN = 400, 4, 64
HIDDEN, BATCH, STEPS, RATE, SEED = 8, 128, 500, 0.02, 7
#: Bytes of a segment and segments side by side in prediction.
SEGMENT, SIDE = 96, 4096


@dataclass
class Network:
    """wx: byte tables, u: recurrent weights, b: biases (each for both directions; update, reset, candidate), wo, bo: output."""

    labels: list[str]
    wx: np.ndarray
    u: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train(windows: np.ndarray, label: np.ndarray, labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """windows: (n, span) bytes; label: (n,) numbers."""
    rng = np.random.default_rng(seed)
    h_, k, span = hidden, len(labels), windows.shape[1]
    f = np.float32
    p = [rng.normal(0, 0.3, (2, 256, 3 * h_)).astype(f), rng.normal(0, h_**-0.5, (2, h_, 3 * h_)).astype(f), np.zeros((2, 1, 3 * h_), f), rng.normal(0, 0.3, (2, h_, k)).astype(f), np.zeros(k, f)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        wx, u, b, wo, bo = p
        rows = rng.integers(0, len(windows), BATCH)
        x = np.stack([windows[rows], windows[rows][:, ::-1]])  # both directions
        y = label[rows]
        h = np.zeros((2, BATCH, h_), f)
        kept = []
        hs = np.zeros((span, 2, BATCH, h_), f)
        for t in range(span):
            xw = np.stack([wx[0][x[0, :, t]], wx[1][x[1, :, t]]]) + b
            hu = h @ u
            zr = _sigmoid(xw[..., : 2 * h_] + hu[..., : 2 * h_])
            z, r = zr[..., :h_], zr[..., h_:]
            c = np.tanh(xw[..., 2 * h_ :] + r * hu[..., 2 * h_ :])
            new = (1 - z) * c + z * h
            kept.append((h, z, r, c, hu[..., 2 * h_ :]))
            hs[t] = h = new
        both = np.stack([hs[:, 0], hs[::-1, 1]])  # (2, span, batch, hidden) in text order
        logits = both[0] @ wo[0] + both[1] @ wo[1] + bo
        e = np.exp(logits - logits.max(-1, keepdims=True))
        d = e / e.sum(-1, keepdims=True)
        d[:, np.arange(BATCH), y] -= 1
        d /= span * BATCH
        g = [np.zeros_like(q) for q in p]
        for j in (0, 1):
            g[3][j] = np.einsum("tbh,tbk->hk", both[j], d)
        g[4] = d.sum((0, 1))
        dh_out = np.stack([d @ wo[0].T, (d @ wo[1].T)[::-1]], 1)  # (span, 2, batch, hidden) in step order
        dh = np.zeros((2, BATCH, h_), f)
        for t in range(span - 1, -1, -1):
            h, z, r, c, hn = kept[t]
            dh = dh + dh_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * hn * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], -1)
            du = np.concatenate([dz, dr, dc * r], -1)
            for j in (0, 1):
                np.add.at(g[0][j], x[j, :, t], dx[j])
                g[1][j] += h[j].T @ du[j]
            g[2] += dx.sum(1, keepdims=True)
            dh = dh * z + du @ u.transpose(0, 2, 1)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g))
        rate = RATE * min(1.0, 2.0 - 2.0 * step / (steps + 1))
        for i, q in enumerate(g):
            q *= min(1.0, 1.0 / (norm + 1e-9))
            m[i] = 0.9 * m[i] + 0.1 * q
            v[i] = 0.99 * v[i] + 0.01 * q * q
            p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(f)
    return Network(labels, *p)


def position_sums(net: Network, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(segments, labels): sums of the position probabilities of segments of up to SEGMENT bytes."""
    h_, k = net.u.shape[1], len(net.labels)
    # the factor 1/2 of a sigmoid by tanh is put into the weights; features come first, so that all steps are contiguous
    half = np.concatenate([np.full(2 * h_, 0.5), np.ones(h_)]).astype(np.float32)
    table = [np.ascontiguousarray(((net.wx[j] + net.b[j]) * half).T) for j in (0, 1)]
    ut = [np.ascontiguousarray((net.u[j] * half).T) for j in (0, 1)]
    wo = [np.ascontiguousarray(net.wo[j].T) for j in (0, 1)]
    out = np.zeros((len(first), k))
    order = np.argsort(-size, kind="stable")  # long segments first: the live ones are always a head of the block
    for a in range(0, len(first), SIDE):
        o = order[a : a + SIDE]
        f, n = first[o], size[o]
        span, side = int(n.max()) if len(n) else 0, len(o)
        live = np.searchsorted(-n, -np.arange(span), "left")  # segments with more than t bytes
        logits = np.zeros((span, k, side), np.float32)
        sums = np.zeros((k, side), np.float32)
        for j in (0, 1):
            h = np.zeros((h_, side), np.float32)
            for s in range(span):
                t = s if j == 0 else span - 1 - s
                m = live[t]
                x = data[f[:m] + t]
                g = np.take(table[j], x, axis=1)
                hm = h[:, :m]
                hu = ut[j] @ hm
                zr = g[: 2 * h_]
                zr += hu[: 2 * h_]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c, hu = g[2 * h_ :], hu[2 * h_ :]
                hu *= zr[h_:]
                c += hu
                np.tanh(c, out=c)
                new = hm - c
                new *= zr[:h_]
                new += c
                h[:, :m] = new
                if j == 0:
                    logits[t, :, :m] = wo[0] @ new
                else:
                    e = wo[1] @ new
                    e += logits[t, :, :m]
                    e += net.bo[:, None]
                    np.clip(e, -60, 60, out=e)
                    np.exp(e, out=e)
                    e /= e.sum(0)
                    sums[:, :m] += e
        out[o] = sums.T
    return out


def predict_texts(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, labels): mean probabilities of the positions of each text; zeros for an empty one."""
    n = np.diff(offs)
    parts = -(-n // SEGMENT)
    row = np.repeat(np.arange(len(n)), parts)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
    first, size = offs[row] + at, np.minimum(SEGMENT, n[row] - at)
    sums = position_sums(net, data, first, size)
    out = np.zeros((len(n), len(net.labels)))
    np.add.at(out, row, sums)
    return out / np.maximum(n, 1)[:, None]


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def sample(docs: DataFrame, learn: Column, label: str, text: str, texts: int, windows: int, span: int) -> pd.DataFrame:
    """Windows of bytes with their label: about ``texts`` texts of each label, taken by hash, ``windows`` evenly placed windows of each."""
    rows = docs.filter(learn & F.col(label).isNotNull() & (F.octet_length(text) > 0)).select(F.col(label).cast("string").alias("y"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    counts = rows.select("y", "h").distinct().groupBy("y").count().collect()  # a row for each label
    if not counts:
        return pd.DataFrame({"y": [], "w": []})
    part = F.create_map(*[x for r in counts for x in (F.lit(r["y"]), F.lit(min(1.0, texts / r["count"])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tb.buffers(b.column("t"))
            y, w = [], []
            for lab, i, j in zip(b.column("y").to_pylist(), offs[:-1], offs[1:]):
                room = max(0, int(j - i) - span)
                for s in sorted({room * q // max(1, windows - 1) for q in range(windows)}):
                    y.append(lab)
                    w.append(data[i + s : min(j, i + s + span)].tobytes())
            yield pa.record_batch([pa.array(y, pa.string()), pa.array(w, pa.binary())], ["y", "w"])

    # copies of a text are drawn together and count once
    chosen = rows.filter(F.pmod("h", F.lit(1_000_000)) < F.element_at(part, F.col("y")) * 1_000_000).dropDuplicates(["y", "h"]).select("y", "t")
    return pd.DataFrame([(r["y"], bytes(r["w"])) for r in chosen.mapInArrow(cut, "y string, w binary").orderBy("y", "w").collect()], columns=["y", "w"])


def fit(docs: DataFrame, learn: Column, label: str = "lang", text: str = "text", texts: int = TEXTS, windows: int = WINDOWS, span: int = SPAN) -> Network | None:
    got = sample(docs, learn, label, text, texts, windows, span)
    if got.empty:
        return None
    labels = sorted(set(got.y))
    x = np.stack([np.frombuffer((w * (span // len(w) + 1))[:span], np.uint8) for w in got.w])  # short texts repeat
    return train(x, got.y.map({y: i for i, y in enumerate(labels)}).to_numpy(), labels)


def identify(docs: DataFrame, net: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (split_of(F.col(doc_id), 3) == 1).alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            letter = b.column("letter").to_numpy(zero_copy_only=False)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if net is not None:
                data, offs = tb.buffers(b.column("text"))
                for i, j in _rows(offs):
                    p = predict_texts(net, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    lang[i:j], score[i:j] = np.array(net.labels, object)[p.argmax(1)], p.max(1)
            lang[~letter], score[~letter] = "und", 0.0
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def _rows(offs: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j
