"""EDF and FIF recordings as a Spark data source that reads ranges of a file: format("pulsegrid_recording").

Headers are read when a query is planned; each partition then reads its own bytes, so one long recording is many tasks and
nothing holds a file whole. Options: ``channels`` (names, comma-separated) prunes what is decoded, ``first`` and ``end`` the
samples that are read, ``rows`` is a partition's size. Filters aren't pushed down: a Python source in Spark 4.1 keeps the
partitions of a frame's first query for its later ones, so a pushed bound would cut those too. Paths are what pyarrow's file systems open (local, hdfs, s3, gs); where only Spark reads
a store, recordings.read_edf takes whole files.

Rows: session_id (the file), sample_idx, sample_rate_hz, and a column for each channel (null if a file lacks it).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Samples of a partition, samples of an Arrow batch.
ROWS, BATCH = 1 << 18, 1 << 14


@dataclass(frozen=True)
class Run:
    """Samples ``first`` to ``first + count``, all of one block of bytes: of one EDF record or FIF buffer, or many in a row."""

    first: int
    count: int
    at: int
    size: int
    kind: str  # NumPy type, or empty for a gap of zeros


@dataclass(frozen=True)
class Header:
    """A file: channels, samples a second, for each channel scale and offset; runs of samples; samples of a record by channel (EDF: channel after channel) or none (FIF: sample after sample)."""

    path: str
    names: tuple[str, ...]
    rate: float
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    runs: tuple[Run, ...]
    record: tuple[int, ...] | None = None
    places: tuple[int, ...] = ()  # of each channel among the values of a record or sample
    width: int = 0  # values of a record or sample


def _open(path: str) -> pa.NativeFile:
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        system, inner = pafs.LocalFileSystem(), path
    return system.open_input_file(inner)


def edf_header(path: str) -> Header:
    with _open(path) as f:
        head = f.read(256)
        text = lambda raw, a, n: raw[a : a + n].decode("latin-1").strip()
        start, records, seconds, n = int(text(head, 184, 8)), int(text(head, 236, 8)), float(text(head, 244, 8)), int(text(head, 252, 4))
        signals, at, fields = f.read(256 * n), 0, {}
        for name, width in (("label", 16), ("kind", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("count", 8)):
            fields[name] = [text(signals, at + i * width, width) for i in range(n)]
            at += n * width
        size = f.size()
    counts = [int(c) for c in fields["count"]]
    keep = [i for i in range(n) if not fields["label"][i].startswith("EDF Annotations")]
    if len({counts[i] for i in keep}) != 1:
        raise ValueError(f"{path}: channels have several rates")
    whole = (size - start) // (2 * sum(counts))
    whole = min(whole, records) if records >= 0 else whole
    scale, offset = [], []
    for i in keep:
        lo, hi, dlo, dhi = (float(fields[k][i]) for k in ("pmin", "pmax", "dmin", "dmax"))
        scale.append((hi - lo) / (dhi - dlo))
        offset.append(lo - dlo * (hi - lo) / (dhi - dlo))
    each = counts[keep[0]]
    starts = np.cumsum([0, *counts])
    runs = (Run(0, whole * each, start, whole * 2 * sum(counts), "<i2"),) if whole else ()
    return Header(path, tuple(fields["label"][i] for i in keep), each / seconds, tuple(scale), tuple(offset), runs, tuple(counts[i] for i in keep), tuple(int(starts[i]) for i in keep), sum(counts))


# FIF's tags, and NumPy types of its numbers.
FILE_ID, DIR_POINTER, DIRECTORY, BLOCK_START, BLOCK_END, NCHAN, SFREQ, CH_INFO, BUFFER, SKIP, RAW_BLOCKS = 100, 101, 102, 104, 105, 200, 201, 203, 300, 301, (102, 112, 119)
FIF_KINDS = {2: ">i2", 3: ">i4", 4: ">f4", 5: ">f8", 16: ">i2"}


def fif_tags(f: pa.NativeFile) -> Iterator[tuple[int, int, int, int]]:
    """(kind, type, size, place of the data) of all tags: from the directory if there is one, else tag after tag."""
    tag = lambda at: (f.seek(at), struct.unpack(">4i", f.read(16)))[1]
    end, at = f.size(), 0
    kind, _, size, _ = tag(0)
    if kind != FILE_ID:
        raise ValueError("no FIF file")
    second = tag(16 + size)
    if second[0] == DIR_POINTER:
        f.seek(32 + size)
        (place,) = struct.unpack(">i", f.read(4))
        if place > 0:
            _, _, length, _ = tag(place)
            f.seek(place + 16)
            for k, t, n, p in struct.iter_unpack(">4i", f.read(length)):
                if p >= 0:
                    yield k, t, n, p + 16
            return
    while 0 <= at <= end - 16:
        kind, type_, size, after = tag(at)
        yield kind, type_, size, at + 16
        if after < 0:
            return
        at = at + 16 + size if after == 0 else after


def fif_header(path: str) -> Header:
    """Channels from the tree's measurement info, raw buffers from the raw-data blocks; a value is raw * range * cal. A skip is so many buffers of zeros."""
    names, scale, runs, blocks, n, rate, at = [], [], [], [], 0, 0.0, 0
    pending = 0
    with _open(path) as f:
        for kind, type_, size, place in fif_tags(f):
            if kind in (BLOCK_START, NCHAN, SFREQ, CH_INFO, SKIP):
                f.seek(place)
                raw = f.read(size)
            if kind == BLOCK_START:
                blocks.append(struct.unpack(">i", raw)[0])
            elif kind == BLOCK_END:
                blocks and blocks.pop()
            elif kind == NCHAN:
                n = struct.unpack(">i", raw)[0]
            elif kind == SFREQ:
                rate = struct.unpack(">f" if size == 4 else ">d", raw)[0]
            elif kind == CH_INFO:
                gain, cal = struct.unpack_from(">2f", raw, 12)
                scale.append(gain * cal)
                names.append(raw[80:96].split(b"\0")[0].decode("latin-1"))
            elif kind == SKIP and set(blocks) & set(RAW_BLOCKS):
                pending += struct.unpack(">i", raw)[0]
            elif kind == BUFFER and set(blocks) & set(RAW_BLOCKS):
                if type_ not in FIF_KINDS:
                    raise ValueError(f"{path}: buffers of type {type_} hold no real numbers")
                count = size // (np.dtype(FIF_KINDS[type_]).itemsize * n)
                if pending:  # as long as the buffer that follows
                    runs.append(Run(at, pending * count, 0, 0, ""))
                    at, pending = at + pending * count, 0
                runs.append(Run(at, count, place, size, FIF_KINDS[type_]))
                at += count
    if len(names) != n:
        raise ValueError(f"{path}: {n} channels, {len(names)} described")
    return Header(path, tuple(names), rate, tuple(scale), (0.0,) * n, tuple(runs), None, tuple(range(n)), n)


def header(path: str) -> Header:
    end = path.rsplit(".", 1)[-1].lower()
    if end not in ("edf", "fif"):
        raise ValueError(f"no reader for .{end}")
    return edf_header(path) if end == "edf" else fif_header(path)


class NoRecording(ValueError, FileNotFoundError):
    pass


def files(path: str) -> list[str]:
    """The recordings of a comma-separated list of files and folders."""
    out = []
    for p in (x.strip() for x in path.split(",")):
        local = "://" not in p
        system, inner = (pafs.LocalFileSystem(), p.removeprefix("file:")) if local else pafs.FileSystem.from_uri(p)
        kind = system.get_file_info(inner).type
        if kind == pafs.FileType.NotFound:
            raise NoRecording(f"no recording at {p}")
        if kind == pafs.FileType.Directory:
            found = sorted(i.path for i in system.get_file_info(pafs.FileSelector(inner)) if i.path.lower().endswith((".edf", ".fif")))
            out += found if local else [f"{p.split('://')[0]}://{x}" for x in found]
        else:
            out.append(inner if local else p)
    return out


@dataclass
class Range(InputPartition):
    """Samples of a file, as pieces of its runs."""

    path: str
    names: tuple[str, ...]
    rate: float
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    record: tuple[int, ...] | None
    places: tuple[int, ...]
    width: int
    runs: tuple[Run, ...]
    low: int
    high: int


def ranges(h: Header, rows: int, low: int = 0, high: int | None = None) -> Iterator[Range]:
    """Partitions of about ``rows`` samples, cut between records or inside buffers, of samples low to high."""
    each = h.record[0] if h.record else 1
    pieces, held = [], 0
    for r in h.runs:
        step, unit = max(1, rows // each) * each, r.size // (r.count // each) if r.size else 0
        for a in range(0, r.count, step):
            n = min(step, r.count - a)
            first = r.first + a
            if first + n <= low or (high is not None and first >= high):
                continue
            if held and held + n > rows:
                yield Range(h.path, h.names, h.rate, h.scale, h.offset, h.record, h.places, h.width, tuple(pieces), low, high if high is not None else 1 << 62)
                pieces, held = [], 0
            pieces.append(Run(first, n, r.at + a // each * unit, n // each * unit, r.kind))
            held += n
    if pieces:
        yield Range(h.path, h.names, h.rate, h.scale, h.offset, h.record, h.places, h.width, tuple(pieces), low, high if high is not None else 1 << 62)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.low, self.high = int(options.get("first", 0)), int(options["end"]) if "end" in options else None

    def partitions(self) -> list[Range]:
        rows = int(self.options.get("rows", ROWS))
        return [r for p in files(self.options["path"]) for r in ranges(header(p), rows, self.low, self.high)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        wanted = [f.name for f in self.schema.fields[3:]]
        at = {n: i for i, n in enumerate(part.names)}
        each = part.record[0] if part.record else 1
        with _open(part.path) as f:
            for r in part.runs:
                unit = r.size // (r.count // each)
                step = max(1, BATCH // each) * each
                for a in range(0, r.count, step):
                    n = min(step, r.count - a)
                    if r.kind:
                        f.seek(r.at + a // each * unit)
                        raw = np.frombuffer(f.read(n // each * unit), r.kind).reshape(-1, part.width)
                    index = np.arange(r.first + a, r.first + a + n)
                    keep = (index >= part.low) & (index < part.high)
                    columns = []
                    for name in wanted:
                        i = at.get(name)
                        if i is None:
                            columns.append(pa.nulls(int(keep.sum()), pa.float64()))
                            continue
                        values = raw[:, part.places[i] : part.places[i] + each].reshape(-1) if r.kind else np.zeros(n)
                        columns.append(pa.array((values.astype(float) * part.scale[i] + part.offset[i])[keep]))
                    k = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * k, pa.string()), pa.array(index[keep], pa.int64()), pa.array(np.full(k, part.rate)), *columns], self.schema.fieldNames())


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulsegrid_recording"

    def schema(self) -> T.StructType:
        # given part by part: this runs in a process without a session
        chosen = [c.strip() for c in self.options.get("channels", "").split(",") if c.strip()]
        if not chosen:
            found = files(self.options["path"])
            chosen = list(dict.fromkeys(n for p in found for n in header(p).names))
        return T.StructType([T.StructField("session_id", T.StringType()), T.StructField("sample_idx", T.LongType()), T.StructField("sample_rate_hz", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in chosen]])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(dict(self.options), schema)


def read_recording(spark: SparkSession, path: str, channels: list[str] | None = None, rows: int = ROWS, first: int = 0, end: int | None = None) -> DataFrame:
    """Samples ``first`` to ``end`` of EDF and FIF files as wide rows; ``channels`` names those that are decoded."""
    files(path)  # what is missing is told here
    spark.dataSource.register(RecordingSource)
    options = {"rows": str(rows), "first": str(first)} | ({"end": str(end)} if end is not None else {}) | ({"channels": ",".join(channels)} if channels else {})
    return spark.read.format("pulsegrid_recording").options(**options).load(path)
