"""Kernels against plain loops, and the same results for any batches."""

import copy
import math
import struct

import numpy as np
import pandas as pd
import pytest

from pulsegrid.functions import filters as Fl
from pulsegrid.functions import units as Un
from pulsegrid.operators import kernels as K
from pulsegrid.operators.host import feed
from pulsegrid.sources.recordings import open_source, parse_edf, parse_xdf

FS = 256.0
RNG = np.random.default_rng(3)
X = RNG.normal(size=700) * 10


def run(kernel, cols, size=None):
    n = len(next(iter(cols.values())))
    k = copy.deepcopy(kernel)
    parts = [k.step({c: v[a : a + (size or n)] for c, v in cols.items()}) for a in range(0, n, size or n)]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def gain(sos, hz, fs=FS):
    z = np.exp(-2j * np.pi * hz / fs * np.arange(3))
    return abs(np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sos]))


@pytest.mark.parametrize("kind,edge", [("butterworth", 0.7071), ("bessel", None), ("chebyshev2", 0.01)])
def test_band_pass_design(kind, edge):
    sos = Fl.bandpass_sos(12, 15, FS, 4, kind)
    assert sos.shape == (4, 6)
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in sos)
    assert gain(sos, math.sqrt(12 * 15)) == pytest.approx(1, abs=0.02)
    assert gain(sos, 3) < 0.02 and gain(sos, 60) < 0.02
    if edge:
        assert gain(sos, 12) == pytest.approx(edge, abs=2e-3) and gain(sos, 15) == pytest.approx(edge, abs=2e-3)


# Sections of a fourth-order Butterworth band-pass, 12 to 15 Hz at 256 Hz.
SECTIONS = [
    [1.6715446089233602e-06, 3.3430892178467204e-06, 1.6715446089233602e-06, 1.0, -1.8185096561303429, 0.9315627107642395],
    [1.0, 2.0, 1.0, 1.0, -1.8412452919491165, 0.9368353820975004],
    [1.0, -2.0, 1.0, 1.0, -1.839707340181905, 0.9695237593944186],
    [1.0, -2.0, 1.0, 1.0, -1.8884806674118457, 0.974950612677361],
]


def test_band_pass_has_the_fixed_sections():
    assert np.allclose(Fl.bandpass_sos(12.0, 15.0, FS, 4), SECTIONS, rtol=1e-8, atol=1e-12)


def test_band_pass_rejects_bad_bands():
    for band in ((0, 5), (5, 4), (5, 128)):
        with pytest.raises(ValueError):
            Fl.bandpass_sos(*band, FS)


def test_constant_input_is_settled_from_the_start():
    y = run(K.Bandpass("x", "y", 12, 15, FS), {"x": np.full(300, 7.0)})["y"]
    assert np.abs(y).max() < 1e-9


def test_smooth_matches_loop():
    a, y, want = Fl.smoothing_factor(0.5, FS), X[0], []
    for v in X:
        y = a * v + (1 - a) * y
        want.append(y)
    np.testing.assert_allclose(run(K.Smooth("x", "y", 0.5, FS), {"x": X})["y"], want, atol=1e-12)


def test_percentile_matches_numpy_and_propagates_nan():
    x = X.copy()
    x[50] = np.nan
    got = run(K.Percentile("x", "p", 70, 40), {"x": x})["p"]
    want = [np.percentile(x[max(0, i - 39) : i + 1], 70) for i in range(len(x))]
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert np.isnan(got[50:90]).all() and not np.isnan(got[90])


def test_percentile_freezes():
    on = np.arange(len(X)) < 100
    got = run(K.Percentile("x", "p", 70, 40, ingest="on"), {"x": X, "on": on})["p"]
    assert (got[100:] == got[99]).all()


def test_tracker_export_and_seed():
    k = K.Percentile("x", "p", 70, 40)
    k.step({"x": X})
    state = k.export()
    assert state["n_eff"] == 40
    other = K.Percentile("x", "p", 70, 40)
    other.seed(state["value"], 40)
    assert other.value() == pytest.approx(state["value"])
    r = K.AutoRange("x", "y", 40)
    r.seed(2.0, 6.0, 40)
    assert r.export()["low"] == pytest.approx(2.2) and r.export()["high"] == pytest.approx(5.8)


def test_dwell_tolerance_and_mask():
    c = np.array([1, 1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 1], bool)
    out = run(K.Dwell("c", "d", 3, 1), {"c": c})
    assert out["d_holds"].tolist() == [False, False, False, True, True, True, False, False, False, False, True, True]
    assert out["d_event"].tolist() == [i in (3, 10) for i in range(12)]
    seen = np.array([1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1], bool)
    held = run(K.Dwell("c", "d", 3, 0, "ok"), {"c": np.array([1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0], bool), "ok": seen})
    assert held["d_event"].tolist() == [i == 4 for i in range(12)]


def test_dwell_rearm_credits_the_dip():
    c = np.array([1, 1, 1, 0, 1, 1, 0, 0, 0, 1, 1], bool)
    assert run(K.DwellRearm("c", "d", 2, 3, 1), {"c": c})["d_event"].nonzero()[0].tolist() == [1, 10]
    assert run(K.DwellRearm("c", "d", 2, 4, 1), {"c": c})["d_event"].nonzero()[0].tolist() == [1]


def test_coherence_bounds():
    t = np.arange(1024) / FS
    a = np.sin(2 * np.pi * 10 * t) * 5 + RNG.normal(size=1024) * 0.1
    k = K.Coherence("a", "b", "c", 8, 12, 512, FS)
    same = run(k, {"a": a, "b": a * 2}, 64)["c"]
    assert (same[:64] == 0).all() and same[-1] == pytest.approx(1)
    noise = run(k, {"a": RNG.normal(size=1024), "b": RNG.normal(size=1024)}, 64)["c"]
    assert 0 <= noise[-1] < 0.8
    with pytest.raises(ValueError):
        K.Coherence("a", "b", "c", 8, 12, 100, FS)


def test_envelope_of_a_tone_is_its_amplitude():
    taps = Fl.envelope_taps(12, 15, FS, 0.25)
    t = np.arange(2048) / FS
    y = np.abs(np.convolve(5 * np.sin(2 * np.pi * 13.5 * t), taps)[:2048])
    assert y[1000:2000] == pytest.approx(np.full(1000, 5.0), rel=0.02)


@pytest.mark.parametrize("kernel", [
    K.Smooth("x", "y", 0.3, FS), K.Bandpass("x", "y", 12, 15, FS), K.Bandpower("x", "y", 12, 15, 64, FS), K.Percentile("x", "y", 70, 50),
    K.AutoRange("x", "y", 50), K.Dwell("c", "y", 3, 1), K.DwellRearm("c", "y", 3, 2, 1),
], ids=lambda k: type(k).__name__)
def test_batches_do_not_matter(kernel):
    cols = {"x": X, "c": X > 0}
    cols = {c: cols[c] for c in kernel.inputs}
    whole = run(kernel, cols)
    for size in (1, 7, 64):
        for c, v in run(kernel, cols, size).items():
            np.testing.assert_allclose(v, whole[c], atol=1e-9)


def test_kernels_see_earlier_outputs():
    out = feed([K.Smooth("x", "s", 0.1, FS), K.Percentile("s", "p", 50, 9)], pd.DataFrame({"x": X[:50]}))
    assert list(out.columns) == ["x", "s", "p"] and out.p.notna().all()


def test_units():
    v = Un.UNITS["uV"][0]
    assert (v * v).sqrt() == v
    with pytest.raises(Un.UnitError):
        v.sqrt()
    with pytest.raises(Un.UnitError):
        v.same(Un.SECOND)
    assert Un.samples(2.5, "s", 1.0) == 2 and Un.samples(3.5, "s", 1.0) == 4


def _edf() -> bytes:
    labels, n = ["Cz", "A1"], 2
    head = b"0".ljust(8) + b"p".ljust(80) + b"r".ljust(80) + b"01.01.26" + b"00.00.00" + str(256 * 3).encode().ljust(8) + b"".ljust(44) + b"3".ljust(8) + b"1".ljust(8) + str(n).encode().ljust(4)
    cols = [("label", labels, 16), ("t", ["", ""], 80), ("u", ["uV", "uV"], 8), ("pmin", ["-100", "-100"], 8), ("pmax", ["100", "100"], 8), ("dmin", ["-1000", "-1000"], 8), ("dmax", ["1000", "1000"], 8), ("f", ["", ""], 80), ("n", ["4", "4"], 8), ("r", ["", ""], 32)]
    head += b"".join(x.encode().ljust(w) for _, v, w in cols for x in v)
    body = np.arange(24, dtype="<i2").reshape(3, 2, 4)
    return head + body.tobytes()


def test_edf(tmp_path, spark):
    names, fs, x = parse_edf(_edf())
    assert names == ["Cz", "A1"] and fs == 4.0 and x.shape == (12, 2)
    assert x[0].tolist() == pytest.approx([0.0, 0.4]) and x[4, 0] == pytest.approx(0.8)
    (tmp_path / "r.edf").write_bytes(_edf())
    from pulsegrid.sources.recordings import open_source

    rows = open_source(spark, str(tmp_path / "r.edf")).orderBy("sample_idx").collect()
    assert len(rows) == 12 and rows[4]["channels"]["Cz"] == pytest.approx(0.8)
    with pytest.raises(ValueError):
        open_source(spark, "a.fif")


def test_null_sessions_and_any_batches(spark):
    from pulsegrid.operators.host import with_kernels
    from pulsegrid.operators.kernels import Coherence, Percentile, Smooth

    rows = [(s, i, i // 8, float((i * 7919) % 101), float((i * 31) % 17)) for s in (None, 1, 2) for i in range(100)]
    samples = spark.createDataFrame(rows, "session_id long, sample_idx long, chunk_id long, x double, y double")
    kernels = [Smooth("x", "s", 0.1, 64.0), Percentile("x", "p", 60.0, 32), Coherence("x", "y", "c", 8.0, 16.0, 64, 64.0)]
    seen = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = with_kernels(samples, kernels).collect()
        by = {s: [(round(r.s, 9), round(r.p, 9), r.c is not None and round(r.c, 9)) for r in sorted(out, key=lambda r: r.sample_idx) if r.session_id == s] for s in (None, 1, 2)}
        assert len(by[None]) == 100 and by[None] == by[1] == by[2]
        seen.append(by)
    assert seen[0] == seen[1]
    assert "c" not in with_kernels(samples, kernels[:2]).columns


def test_live_time_constant_and_duration():
    x, tau = RNG.normal(size=90), np.r_[np.full(30, 0.5), np.full(20, 0.1), np.full(10, -1.0), np.full(30, 0.5)]
    y, want, last = x[0], [], 0.5
    for v, t in zip(x, tau):
        last = t if t > 0 else last
        y += (1 - math.exp(-1 / (last * FS))) * (v - y)
        want.append(y)
    for size in (None, 7):
        np.testing.assert_allclose(run(K.Smooth("x", "y", 0.5, FS, "t"), {"x": x, "t": tau}, size)["y"], want)
    c, n = np.ones(8, bool), np.array([2, 2, 2, 3, 3, 3, 0, 3.0])
    got = run(K.Dwell("c", "d", 2, count_column="n"), {"c": c, "n": n}, 3)
    assert got["d_holds"].tolist() == [False, True, True, False, False, True, True, True]
    assert got["d_event"].tolist() == [False, True, False, False, False, True, False, False]


def test_gate_keeps_its_hangover_between_batches():
    a = np.array([False, True, False, False, False, False, True, False])
    for size in (None, 1, 3):
        assert run(K.Gate("a", "g", 2), {"a": a}, size)["g"].tolist() == [False, True, True, True, False, False, True, True]


def _xdf() -> tuple[bytes, np.ndarray]:
    chunk = lambda tag, body: b"\x04" + struct.pack("<IH", len(body) + 2, tag) + body
    info = lambda n, name, kind, form, more="": f"<info><name>{name}</name><type>{kind}</type><channel_count>{n}</channel_count><nominal_srate>250</nominal_srate><channel_format>{form}</channel_format>{more}</info>".encode()
    x = RNG.normal(size=(5, 2)).astype("<f4")
    rows = [(b"\x08" + struct.pack("<d", i) if i % 2 == 0 else b"\x00") + r.tobytes() for i, r in enumerate(x)]
    labels = "<desc><channels><channel><label>Cz</label></channel><channel><label>Pz</label></channel></channels></desc>"
    return b"XDF:" + b"".join([
        chunk(1, b"<info><version>1.0</version></info>"), chunk(2, struct.pack("<I", 7) + info(1, "marks", "Markers", "string")),
        chunk(2, struct.pack("<I", 1) + info(2, "amp", "EEG", "float32", labels)), chunk(3, struct.pack("<I", 1) + b"\x01\x03" + b"".join(rows[:3])),
        chunk(4, bytes(20)), chunk(3, struct.pack("<I", 1) + b"\x04" + struct.pack("<I", 2) + b"".join(rows[3:])), chunk(6, struct.pack("<I", 1) + b"<info/>"),
    ]), x


def test_xdf(tmp_path, spark):
    raw, x = _xdf()
    names, fs, got = parse_xdf(raw)
    assert (names, fs) == (["Cz", "Pz"], 250.0)
    np.testing.assert_array_equal(got, x.astype(float))
    for bad in ("marks", "none"):
        with pytest.raises(ValueError):
            parse_xdf(raw, bad)
    (tmp_path / "a.xdf").write_bytes(raw)
    rows = open_source(spark, str(tmp_path / "a.xdf")).orderBy("sample_idx").collect()
    assert [r.channels["Pz"] for r in rows] == x[:, 1].astype(float).tolist()
