"""Recordings as sample tables: Parquet, EDF and XDF."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranged


def open_source(spark: SparkSession, path: str) -> DataFrame:
    """A reader by extension: .edf, .xdf, .fif, .parquet. EDF and XDF come whole, a task a file; ranged.read_recording reads parts of EDF and FIF files."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "edf":
        return read_edf(spark, path)
    if end == "xdf":
        return read_xdf(spark, path)
    if end == "fif":
        return ranged.read_recording(spark, path)
    if end == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{end}; convert it to EDF, FIF or Parquet")


def parse_edf(raw: bytes) -> tuple[list[str], float, np.ndarray]:
    """Channel names, samples a second, (samples, channels) in physical units; channels need one rate."""
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    header, records, seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    at, fields = 256, {}
    for name, width in (("label", 16), ("kind", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("count", 8), ("free", 32)):
        fields[name] = [text(at + i * width, width) for i in range(n)]
        at += n * width
    counts = [int(c) for c in fields["count"]]
    keep = [i for i in range(n) if not fields["label"][i].startswith("EDF Annotations")]
    if len({counts[i] for i in keep}) > 1:
        raise ValueError("channels have several rates")
    data = np.frombuffer(raw, "<i2", offset=header).reshape(-1, sum(counts))
    data = data[:records] if records >= 0 else data
    starts = np.cumsum([0, *counts])
    out = []
    for i in keep:
        lo, hi, dlo, dhi = (float(fields[k][i]) for k in ("pmin", "pmax", "dmin", "dmax"))
        out.append((data[:, starts[i] : starts[i + 1]].reshape(-1) - dlo) * (hi - lo) / (dhi - dlo) + lo)
    return [fields["label"][i] for i in keep], counts[keep[0]] / seconds, np.stack(out, 1)


#: NumPy types of XDF's number formats.
XDF_FORMATS = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8"}


def _xdf_chunks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, content) of each chunk; a length is one byte that gives its own width, then the number."""
    at = 4
    while at < len(raw):
        size, at = _xdf_length(raw, at)
        yield struct.unpack_from("<H", raw, at)[0], raw[at + 2 : at + size]
        at += size


def _xdf_length(raw: bytes, at: int) -> tuple[int, int]:
    width = raw[at]
    return int.from_bytes(raw[at + 1 : at + 1 + width], "little"), at + 1 + width


def _xdf_samples(body: bytes, kind: np.dtype, n: int) -> np.ndarray:
    """Samples of one chunk: each is a byte (8: a time stamp follows), then a value a channel."""
    count, at = _xdf_length(body, 0)
    out, size = np.empty((count, n)), kind.itemsize * n
    for i in range(count):
        at += 1 + body[at]
        out[i] = np.frombuffer(body, kind, n, at)
        at += size
    return out


def parse_xdf(raw: bytes, stream: str | None = None) -> tuple[list[str], float, np.ndarray]:
    """Channel names, samples a second, (samples, channels) of one stream: the named one, else the first of type EEG, else the first."""
    if raw[:4] != b"XDF:":
        raise ValueError("no XDF file")
    heads, data = {}, {}
    for tag, body in _xdf_chunks(raw):
        if tag in (2, 3):
            sid = struct.unpack_from("<I", body)[0]
            if tag == 2:
                heads[sid] = ElementTree.fromstring(body[4:])
            else:
                data.setdefault(sid, []).append(body[4:])
    if not heads:
        raise ValueError("no streams")
    named = [i for i, h in heads.items() if h.findtext("name") == stream]
    eeg = [i for i, h in heads.items() if (h.findtext("type") or "").upper() == "EEG"]
    if stream is not None and not named:
        raise ValueError(f"no stream named {stream}; there are {[h.findtext('name') for h in heads.values()]}")
    sid = (named or eeg or list(heads))[0]
    head, n = heads[sid], int(heads[sid].findtext("channel_count"))
    if head.findtext("channel_format") not in XDF_FORMATS:
        raise ValueError(f"a stream of {head.findtext('channel_format')} holds no numbers")
    labels = [c.findtext("label") or f"ch{i}" for i, c in enumerate(head.findall("desc/channels/channel"))]
    kind = np.dtype(XDF_FORMATS[head.findtext("channel_format")])
    x = np.concatenate([np.empty((0, n)), *[_xdf_samples(b, kind, n) for b in data.get(sid, [])]])
    return labels if len(labels) == n else [f"ch{i}" for i in range(n)], float(head.findtext("nominal_srate")), x


def _read_files(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[list[str], float, np.ndarray]]) -> DataFrame:
    """session_id (the file), sample_idx, sample_rate_hz, channels (map of name to value): a task for each file."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                names, fs, x = parse(raw)
                for a in range(0, len(x), 50_000):
                    part = x[a : a + 50_000]
                    yield pd.DataFrame({"session_id": name, "sample_idx": np.arange(a, a + len(part)), "sample_rate_hz": fs, "channels": [dict(zip(names, r)) for r in part.tolist()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(each, "session_id string, sample_idx long, sample_rate_hz double, channels map<string,double>")


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    return _read_files(spark, path, parse_edf)


def read_xdf(spark: SparkSession, path: str, stream: str | None = None) -> DataFrame:
    return _read_files(spark, path, lambda raw: parse_xdf(raw, stream))


def align(samples: DataFrame, other: DataFrame, value: str = "x", out: str = "aligned") -> DataFrame:
    """The last value of ``other`` (session_id, sample_idx, value) at or before each sample; an extra."""
    from pyspark.sql import Window

    marks = other.select("session_id", "sample_idx", F.col(value).alias("_v"), F.lit(0).alias("_o"))
    both = samples.withColumn("_o", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("session_id").orderBy("sample_idx", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).filter("_o = 1").drop("_v", "_o")


def write_events(events: DataFrame, path: str) -> None:
    """Output rows as JSON lines."""
    events.write.mode("overwrite").json(path)
