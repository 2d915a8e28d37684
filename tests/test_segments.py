"""Recursions and long windows on segments: equal to the serial kernels, with more tasks than sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.operators.host import with_kernels
from pulsegrid.operators.segments import with_memory, with_scan

LINEAR = [K.Smooth("x", "y", 0.7, 64), K.Bandpass("x", "y", 8, 12, 256), K.Bandpass("x", "y", 8, 12, 256, 4, "chebyshev2"), K.Bandpass("x", "y", 1, 3, 128, 4, "bessel")]
FINITE = [(K.Percentile("x", "y", 65, 200), 199), (K.AutoRange("x", "y", 150), 149), (K.MovingMean("x", "y", 90, True), 89), (K.Fir("x", "y", np.hanning(301)), 300), (K.Autocorrelation("x", "y", 5, 120), 119)]


@pytest.fixture(scope="module")
def rows(spark):
    """A long session, a short one and one without an id."""
    long = spark.range(20_000).select(F.lit("long").alias("session_id"), F.col("id").alias("sample_idx"))
    short = spark.range(60).select(F.when(F.col("id") < 50, "short").alias("session_id"), (F.col("id") % 50).alias("sample_idx"))
    return long.unionByName(short).withColumn("x", 50 + 30 * F.sin(F.col("sample_idx") / 7) + F.pmod(F.hash("session_id", "sample_idx"), F.lit(40))).checkpoint()


def values(df):
    return {(r.session_id, r.sample_idx): r.y for r in df.select("session_id", "sample_idx", "y").collect()}


def same(a, b):
    assert a.keys() == b.keys()
    k = list(a)
    assert np.allclose([a[i] for i in k], [b[i] for i in k], 1e-9, 1e-9)


@pytest.mark.parametrize("kernel", LINEAR, ids=lambda k: type(k).__name__)
def test_scan_is_the_serial_recursion(rows, kernel):
    got = with_scan(rows, kernel, 1000)
    assert got.columns == [*rows.columns, "y"]
    same(values(got), values(with_kernels(rows, [kernel])))


def test_one_session_is_many_tasks(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = rows.filter("session_id = 'long'")
        assert with_scan(one, K.Smooth("x", "y", 0.7, 64), 1000).select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert with_memory(one, 99, [K.Percentile("x", "y", 65, 100)], 1000).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kernel, memory", FINITE, ids=lambda k: type(k).__name__)
def test_finite_memory(rows, kernel, memory):
    same(values(with_memory(rows, memory, [kernel], 1500)), values(with_kernels(rows, [kernel])))
    same(values(with_memory(rows, memory, [kernel], 100)), values(with_kernels(rows, [kernel])))


@pytest.mark.parametrize("taps", [np.hanning(64), np.exp(0.3j * np.arange(193)), np.ones(1), np.arange(1.0, 1001)])
def test_overlap_save_is_the_convolution(taps):
    x = np.random.default_rng(0).normal(size=3000)
    k = K.Fir("x", "y", taps)
    got = np.concatenate([k.step({"x": x[a:b]})["y"] for a, b in zip([0, 1, 7, 900, 2000], [1, 7, 900, 2000, 3000])])
    want = np.convolve(x, taps)[:3000]
    assert np.allclose(got, np.abs(want) if np.iscomplexobj(taps) else want, 1e-9, 1e-9 * np.abs(taps).sum())


def test_autocorrelation_is_the_definition():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=700) * 5 + 1e4, np.full(60, 3.0), rng.normal(size=100)])
    k = K.Autocorrelation("x", "y", 4, 30)
    got = np.concatenate([k.step({"x": x[a:b]})["y"] for a, b in zip([0, 3, 300, 500], [3, 300, 500, 860])])
    want = [k._one(x[max(0, i - 29) : i + 1]) for i in range(860)]
    assert np.allclose(got, want, 1e-6, 1e-6) and got[:5].tolist() == [0.0] * 5 and got[740] == 0.0
    x[100] = np.nan
    got = K.Autocorrelation("x", "y", 4, 30).step({"x": x})["y"]
    assert np.isnan(got[100:130]).all() and np.allclose(got[130:], want[130:], 1e-6, 1e-6)


def test_live_time_constants_are_refused(rows):
    with pytest.raises(ValueError, match="affine"):
        with_scan(rows, K.Smooth("x", "y", 0.7, 64, "tau"))
