"""EDF and FIF files read by ranges: the same rows as whole files, many partitions, pruned channels, bounds."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import ranged
from pulsegrid.sources.recordings import open_source, parse_edf

RNG = np.random.default_rng(8)


def write_edf(path, x, each, note=False, records=None):
    """Channels of int16 with two scalings; a last signal of annotations if asked."""
    n, k = x.shape[1] + note, len(x) // each
    pad = lambda v, w: str(v).ljust(w).encode()
    labels = [f"C{i}" for i in range(x.shape[1])] + ["EDF Annotations"] * note
    counts = [each] * x.shape[1] + [4] * note
    head = pad("0", 8) + pad("", 160) + pad("", 16) + pad(256 * (n + 1), 8) + pad("", 44) + pad(k if records is None else records, 8) + pad(1, 8) + pad(n, 4)
    for values, w in ((labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-100 * (i + 1) for i in range(n)], 8), ([100 * (i + 1) for i in range(n)], 8), ([-2000] * n, 8), ([2000] * n, 8), ([""] * n, 80), (counts, 8), ([""] * n, 32)):
        head += b"".join(pad(v, w) for v in values)
    body = b"".join(b"".join(x[r * each : (r + 1) * each, i].astype("<i2").tobytes() for i in range(x.shape[1])) + b"\0\0" * 4 * note for r in range(k))
    path.write_bytes(head + body)
    return x * (np.arange(1, x.shape[1] + 1) * 100.0 / 2000)


def write_fif(path, buffers, rate, directory, kind=4, skip_before=None):
    """A minimal FIF: measurement info, raw data; a skip of one buffer before buffer ``skip_before``."""
    n, tags, places = buffers[0].shape[1], [], []
    number = lambda v: struct.pack(">i", v)
    info = [struct.pack(">3i2f", i + 1, i + 1, 2, 2.0, 0.5 * (i + 1)) + bytes(60) + f"E{i}".encode().ljust(16, b"\0") for i in range(n)]
    tags += [(100, 31, bytes(20)), (101, 3, number(-1)), (104, 3, number(100)), (104, 3, number(101)), (200, 3, number(n)), (201, 4, struct.pack(">f", rate))]
    tags += [(203, 30, i) for i in info] + [(105, 3, number(101)), (104, 3, number(102))]
    for k, b in enumerate(buffers):
        tags += [(301, 3, number(1))] * (k == skip_before) + [(300, kind, b.astype(ranged.FIF_KINDS[kind]).tobytes())]
    tags += [(105, 3, number(102)), (105, 3, number(100))]
    raw = b""
    for k, t, data in tags:
        places.append((k, t, len(data), len(raw)))
        raw += struct.pack(">4i", k, t, len(data), 0) + data
    if directory:
        place = len(raw)
        entries = b"".join(struct.pack(">4i", *p) for p in places)
        raw += struct.pack(">4i", 102, 32, len(entries), -1) + entries
        raw = raw[:52] + number(place) + raw[56:]
    else:
        raw = raw[: places[-1][3] + 12] + number(-1) + raw[places[-1][3] + 16 :]
    path.write_bytes(raw)
    gaps = [np.zeros_like(b) if k == skip_before else None for k, b in enumerate(buffers)]
    whole = np.concatenate([y for g, b in zip(gaps, buffers) for y in (g, b) if y is not None])
    return whole * (np.arange(1, n + 1) * 1.0)


def test_edf_ranges_are_the_whole_file(spark, tmp_path):
    want = write_edf(tmp_path / "a.edf", RNG.integers(-2000, 2000, (800, 3)), 16, note=True)
    df = ranged.read_recording(spark, str(tmp_path / "a.edf"), rows=100)
    assert df.columns == ["session_id", "sample_idx", "sample_rate_hz", "C0", "C1", "C2"] and df.rdd.getNumPartitions() == 9
    got = np.array([r[1:] for r in df.orderBy("sample_idx").collect()])
    assert (got[:, 0] == np.arange(800)).all() and (got[:, 1] == 16).all() and np.allclose(got[:, 2:], want)
    names, rate, whole = parse_edf((tmp_path / "a.edf").read_bytes())
    assert names == ["C0", "C1", "C2"] and rate == 16 and np.allclose(whole, want)


def test_pruned_channels_and_bounds(spark, tmp_path):
    want = write_edf(tmp_path / "a.edf", RNG.integers(-2000, 2000, (800, 3)), 16)
    write_edf(tmp_path / "b.edf", RNG.integers(-2000, 2000, (160, 2)), 16, records=-1)
    df = ranged.read_recording(spark, str(tmp_path), ["C2", "C0"], rows=64)
    got = ranged.read_recording(spark, str(tmp_path), ["C2", "C0"], 64, 300, 331)
    assert df.filter("sample_idx < 5").count() == 10 and df.count() == 960  # a filter of one query doesn't cut the next
    assert got.rdd.getNumPartitions() < df.rdd.getNumPartitions() // 4
    rows = got.orderBy("sample_idx").collect()
    assert np.allclose([[r.C2, r.C0] for r in rows], want[300:331][:, [2, 0]])
    both = df.groupBy(F.regexp_extract("session_id", r"(\w)\.edf", 1).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count("C2").alias("c2")).collect()
    assert sorted(map(tuple, both)) == [("a", 800, 800), ("b", 160, 0)]


@pytest.mark.parametrize("kind", [2, 3, 4, 5])
@pytest.mark.parametrize("directory", [True, False])
def test_fif(spark, tmp_path, kind, directory):
    buffers = [RNG.integers(-900, 900, (n, 4)).astype(float) for n in (50, 50, 50, 23)]
    want = write_fif(tmp_path / "r.fif", buffers, 250.0, directory, kind, skip_before=2)
    h = ranged.header(str(tmp_path / "r.fif"))
    assert h.names == ("E0", "E1", "E2", "E3") and h.rate == 250.0 and [r.count for r in h.runs] == [50, 50, 50, 50, 23]
    part = [b for r in ranged.ranges(h, 40) for b in ranged.Reader({}, spark.createDataFrame([], "s string, i long, r double, E0 double, E1 double, E2 double, E3 double").schema).read(r)]
    got = np.concatenate([np.stack([b.column(k).to_numpy() for k in range(3, 7)], 1) for b in part])
    assert np.allclose(got, want) and np.concatenate([b.column(1).to_numpy() for b in part]).tolist() == list(range(223))


def test_fif_through_spark(spark, tmp_path):
    buffers = [RNG.normal(size=(64, 2)).astype("f4").astype(float) for _ in range(10)]
    want = write_fif(tmp_path / "r.fif", buffers, 128.0, True)
    df = ranged.read_recording(spark, str(tmp_path / "r.fif"), rows=128)
    assert df.rdd.getNumPartitions() == 5
    assert np.allclose([[r.E0, r.E1] for r in df.orderBy("sample_idx").collect()], want)
    assert open_source(spark, str(tmp_path / "r.fif")).count() == 640


def test_refusals(tmp_path):
    (tmp_path / "x.fif").write_bytes(struct.pack(">4i", 7, 3, 4, 0) + bytes(4))
    with pytest.raises(ValueError, match="no FIF"):
        ranged.header(str(tmp_path / "x.fif"))
    with pytest.raises(ValueError, match="no reader"):
        ranged.header(str(tmp_path / "x.abc"))
