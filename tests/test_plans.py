"""Segments, protocols, phases, controls, streaming, alignment."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import expr as X
from pulsegrid.functions import montage
from pulsegrid.operators import kernels as K
from pulsegrid.operators import runs, windows
from pulsegrid.operators.host import with_kernels
from pulsegrid.operators.samples import with_chunk, with_windows
from pulsegrid.plans import advisor, session
from pulsegrid.sources.recordings import align
from pulsegrid.streaming.processor import stream_kernels, stream_outputs

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def samples(spark):
    pdf = pd.DataFrame([(s, i, float(v)) for s in (1, 2) for i, v in enumerate(RNG.normal(size=130) * 10)], columns=["session_id", "sample_idx", "x"])
    return with_chunk(spark.createDataFrame(pdf), 8).cache()


def frame(df, *cols):
    return df.orderBy("session_id", "sample_idx").select(*cols).toPandas()


def test_segments_give_what_sessions_give(samples):
    def cols(w):
        return {"p": windows.rolling_percentile(F.col("x"), 60.0, 12, w), "d": windows.differentiate(F.col("x"), 8.0, w), "f": windows.fir(F.col("x"), np.arange(6.0), w)}

    whole = frame(with_windows(samples, 12, cols), "p", "d", "f")
    for segment in (13, 40):
        pd.testing.assert_frame_equal(frame(with_windows(samples, 12, cols, segment), "p", "d", "f"), whole)


def test_kernels_keep_sessions_apart_for_any_partitions(samples):
    ks = [K.Smooth("x", "y", 0.2, 8.0), K.Coherence("x", "y", "c", 0.5, 3.5, 16, 8.0)]
    want = frame(with_kernels(samples, ks), "y", "c")
    got = frame(with_kernels(samples.repartition(7), ks), "y", "c")
    pd.testing.assert_frame_equal(got, want)
    one = with_kernels(samples.filter("session_id = 2"), ks)
    pd.testing.assert_frame_equal(frame(one, "y", "c"), want.iloc[130:].reset_index(drop=True))


def test_small_arrow_batches(spark, samples):
    ks = [K.Coherence("x", "x", "c", 0.5, 3.5, 16, 8.0), K.Percentile("x", "p", 50, 9)]
    want = frame(with_kernels(samples, ks), "c", "p")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        pd.testing.assert_frame_equal(frame(with_kernels(samples, ks), "c", "p"), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streaming_equals_batch(spark, samples, tmp_path):
    ks = [K.Smooth("x", "y", 0.2, 8.0), K.Dwell("up", "d", 2, 1)]
    s = samples.withColumn("up", F.col("x") > 0)
    want = frame(with_kernels(s, ks), "y", "d_event")
    s.repartition(6, "sample_idx").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_kernels(stream, ks).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    pd.testing.assert_frame_equal(frame(spark.read.parquet(str(tmp_path / "out")), "y", "d_event"), want)


def test_nan_compares_false_and_division_is_finite(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (1.0, 0.0), (0.0, 0.0), (4.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(X.gt(a, b).alias("g"), X.eq(a, a).alias("e"), X.div(a, b).alias("q"), X.clip01(a).alias("c")).collect()
    assert [r.g for r in rows] == [False, True, False, True]
    assert [r.e for r in rows] == [False, True, True, True]
    assert [r.q for r in rows] == [0.0, 0.0, 0.0, 2.0]
    assert math.isnan(rows[0].c)


def test_montages_need_their_channels():
    for bad in (lambda: montage.bipolar(["Cz"], "Cz", "Pz"), lambda: montage.referential(["Cz"], "Cz", "Pz"), lambda: montage.passthrough(["Cz", "Pz"])):
        with pytest.raises(montage.ChannelError):
            bad()


def test_phases_last_whole_chunks():
    ranges = session.phase_ranges([session.Phase("a", 9), session.Phase("b", 0), session.Phase("c", None), session.Phase("d", 8)], 8)
    assert [(i, a, b) for i, _, a, b in ranges] == [(0, 0, 2), (1, 2, 3), (2, 3, None)]


def test_sessions_stop_after_timed_phases(samples):
    d = session.with_phase(samples, [session.Phase("a", 8), session.Phase("b", 16, True)], 8)
    assert d.filter("session_id = 1").count() == 24


def test_short_warmup_fails_closed(samples):
    r = session.seeds(samples, F.col("x"), F.col("chunk_id") < 1, 50.0, 20).first()
    assert r.seed_samples == 8 and not r.seeded


def test_release_of_zero_is_200_ms():
    assert runs.release_samples(0.0, 100.0) == runs.release_samples(None, 100.0) == 20
    assert runs.release_samples(50.0, 100.0) == 5


def test_align_takes_the_last_value(spark, samples):
    other = spark.createDataFrame([(1, 3, 7.0), (1, 10, 8.0)], "session_id long, sample_idx long, x double")
    got = align(samples.filter("session_id = 1 and sample_idx < 12"), other).orderBy("sample_idx").select("aligned").toPandas().aligned.tolist()
    assert np.isnan(got[2]) and got[3] == got[9] == 7.0 and got[10] == 8.0


def test_limiter_and_step(spark):
    df = spark.createDataFrame([("easier", 1.0), ("harder", 1.0), ("hold", 1.0)], "advice string, v double")
    lim = advisor.limiter(F.col("advice"), {"a": F.lit(0.2), "b": F.lit(0.9)})
    rows = df.select(lim.alias("l"), advisor.propose(F.col("v"), F.col("advice"), 0.5, 0.0, 1.2).alias("p")).collect()
    assert [(r.l, r.p) for r in rows] == [("a", 0.5), ("b", 1.2), (None, 1.0)]


def test_suggestions_wait_and_reverse(spark):
    rows = [(1, i, a) for i, a in enumerate(["hold", "harder", "harder", "hold", "easier", "easier", "harder"])]
    df = spark.createDataFrame(rows, "session_id long, chunk_id long, advice string")
    got = advisor.suggest(df, 3).orderBy("chunk_id").collect()
    assert [r.suggested for r in got] == [False, True, False, False, True, False, False]
    assert [r.reversal for r in got] == [False, False, False, False, True, False, False]


def test_requirements(samples):
    from pulsegrid.plans import requirements as R

    assert R.sample_rate(200, [128, 256, 512]) == 512 and R.sample_rate(None, None) == 256 and R.sample_rate(100, None) == 100
    assert R.channels(samples, ["all"], {"all": ["x"]}) == ["x"]
    assert R.coupling("DC", ["AC", "DC"]) == "DC" and R.coupling("DC", None) == "DC" and R.coupling(None, []) is None
    for bad in (lambda: R.sample_rate(1000, [256]), lambda: R.channels(samples, ["Cz"]), lambda: R.coupling("DC", ["AC"])):
        with pytest.raises(R.RequirementError):
            bad()


def test_custom_functions(samples):
    from pulsegrid.functions import custom

    custom.function("twice")(_twice)
    rows = samples.select("x", custom.FUNCTIONS["twice"](F.col("x")).alias("y")).limit(5).collect()
    assert all(r.y == 2 * r.x for r in rows)


def _twice(x: pd.Series) -> pd.Series:
    return x * 2


def walk(phases, rows):
    k = session.Cursor(phases)
    cols = {n: np.array([r.get(n, math.nan) for r in rows]) for n in ("advance", "hold", "freeze")}
    return k.step({"n": np.full(len(rows), 8.0), **cols})["at"].tolist()


def test_commands_move_the_cursor():
    floor = [session.Phase("a", 16, floor=True), session.Phase("b", 8), session.Phase("c", None)]
    assert walk(floor, [{}] * 5) == [0, 0, 1, 2, 2]
    assert walk(floor, [{"hold": 1.0}, {}, {}, {"hold": 0.0}, {}, {}]) == [0, 0, 0, 0, 1, 2]
    assert walk(floor, [{"freeze": 1.0}, {}, {"freeze": 0.0}, {}, {}]) == [0, 0, 0, 0, 1]
    assert walk(floor, [{"advance": 1.0}, {"hold": 1.0}, {}, {"advance": 1.0}, {}]) == [1, 2, 2, -1, -1]
    assert walk([session.Phase("a", 8)], [{}, {"advance": 1.0}]) == [0, -1]


def test_cursor_without_commands_is_the_timeline(spark, samples):
    phases = [session.Phase("a", 20, True), session.Phase("b", 40), session.Phase("c", 8)]
    d = with_chunk(samples, 8)
    none = spark.createDataFrame([], "session_id long, chunk_id long, name string, value double")
    cols = ["session_id", "sample_idx", "phase_index", "phase", "phase_muted"]
    got, want = (sorted(map(tuple, x.select(cols).collect())) for x in (session.with_commands(d, phases, none), session.with_phase(d, phases, 8)))
    assert got == want and got


def test_resets_start_holds_anew(spark):
    rows = [(1, i, c, r) for i, (c, r) in enumerate([(True, False), (True, False), (True, True), (True, False), (False, False), (True, True)])]
    d = spark.createDataFrame(rows, "session_id long, sample_idx long, c boolean, r boolean")
    out = runs.with_dwell(d, F.col("c"), 2, "h", F.col("r")).orderBy("sample_idx").collect()
    assert [r.h_holds for r in out] == [False, True, False, True, False, False]
    assert [r.h_event for r in out] == [False, True, False, True, False, False]


def test_a_gate_that_is_not_allowed_waits(spark):
    rows = [(1, i, a, ok) for i, (a, ok) in enumerate([(True, True), (False, False), (True, False), (False, True), (False, True), (False, None)])]
    d = spark.createDataFrame(rows, "session_id long, sample_idx long, a boolean, ok boolean")
    out = runs.with_gate(d, F.col("a"), 1, F.col("ok"), "g").orderBy("sample_idx").collect()
    assert [r.g_gated for r in out] == [True, False, False, True, False, False]


def test_seeds_take_effect_fail_closed_or_are_disarmed(spark):
    d = with_chunk(spark.createDataFrame([(s, i, float(i)) for s in (1, 2, 3, 4) for i in range(6)], "session_id long, sample_idx long, x double"), 2)
    seeds = spark.createDataFrame([(1, 7.0, True), (2, 7.0, False), (4, 7.0, True)], "session_id long, seed double, seeded boolean")
    host = spark.createDataFrame([(3, 0, "thr", 5.0), (4, 2, "thr", 9.0)], "session_id long, chunk_id long, name string, value double")
    out = session.with_seed(d, seeds, host, "thr", 1.0, 1).orderBy("session_id", "sample_idx").collect()
    each = {s: [(r.thr, r.seed_muted) for r in out if r.session_id == s][::2] for s in (1, 2, 3, 4)}
    assert each[1] == [(1.0, False), (7.0, False), (7.0, False)]
    assert each[2] == [(1.0, False), (1.0, True), (1.0, True)]
    assert each[3] == [(5.0, False)] * 3
    assert each[4] == [(1.0, False), (7.0, False), (9.0, False)]


def test_kernels_take_nan_in_columns_that_are_never_null(spark):
    d = spark.range(4).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("sample_idx"), F.coalesce(F.lit(None).cast("double"), F.lit(float("nan"))).alias("x"))
    assert len(with_kernels(d, [K.Dwell("x", "d", 1)]).collect()) == 4


def test_known_channels_keep_their_kind():
    from pulsegrid.operators import outputs

    outputs.check_kind("event", "audio_chime")
    outputs.check_kind("event", "anything")
    with pytest.raises(ValueError):
        outputs.check_kind("analog", "audio_chime")


def test_reseeds_wait_for_fresh_samples_and_end_with_the_host(spark):
    n = 12
    d = spark.createDataFrame([(s, i, i // 2, float(i), 1.0) for s in (1, 2, 3) for i in range(n)], "session_id long, sample_idx long, chunk_id long, x double, thr double")
    host = spark.createDataFrame([(2, 3, "thr", 9.0), (1, 0, "other", 5.0)], "session_id long, chunk_id long, name string, value double")
    d = session.with_controls(d.drop("thr"), host, {"thr": 1.0})
    fresh = (F.col("sample_idx") != 1) & ((F.col("session_id") != 3) | (F.col("sample_idx") > 9))
    out = session.with_reseeds(d, host, "thr", F.col("x"), F.col("chunk_id"), fresh, 50.0, 3, dead=F.col("session_id") == 3).orderBy("session_id", "sample_idx").collect()
    each = {s: [r.thr for r in out if r.session_id == s] for s in (1, 2, 3)}
    # 0, 2, 3 are fresh before chunk 2; 5, 6, 7 are the last three of four before chunk 4
    assert each[1] == [1.0] * 4 + [2.0] * 4 + [6.0] * 4
    assert each[2] == [1.0] * 4 + [2.0] * 2 + [9.0] * 6
    assert each[3] == [1.0] * n
    assert [(r.session_id, r.sample_idx) for r in out if r.hold_reset] == [(1, 4), (1, 8), (2, 4)]


def test_live_outputs_are_those_of_the_batch_for_any_split(spark, samples, tmp_path):
    taps = np.array([0.5, 0.25, -0.25])
    steps = [
        K.Fir("x", "y", taps), K.Map(["x"], "loud", lambda x: x > 14.0, "boolean"), K.Gate("loud", "muted", 2),
        K.Map(["y"], "c", lambda y: y > 0, "boolean"), K.Dwell("c", "d", 2),
    ]
    channels = [("analog", "gain", "y"), ("event", "bell", "d_event")]
    batch = with_windows(samples, 3, lambda w: {"y": windows.fir(F.col("x"), taps, w)}).withColumn("muted", runs.hangover(F.col("x") > 14.0, 2))
    batch = runs.with_dwell(batch, F.col("y") > 0, 2, "d").filter("sample_idx < 128")  # 130 samples: the last chunk isn't whole
    from pulsegrid.operators import outputs

    want = outputs.emitted(batch, [("analog", "gain", F.col("y")), ("event", "bell", F.col("d_event"))], F.col("muted"), 8.0)
    for parts in (2, 5):
        at = f"{tmp_path}/{parts}"
        s = samples.drop("chunk_id")
        s.repartition(parts, "sample_idx").write.parquet(f"{at}/in")
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        q = stream_outputs(stream, steps, channels, 8, 8.0, "muted").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        keys = ["session_id", "timestamp_s", "channel", "kind"]
        a, b = (x.orderBy(*keys).select(*keys, "value").toPandas() for x in (spark.read.parquet(f"{at}/out"), want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_a_ledger_keeps_suggestions_until_they_are_used_or_fall(spark):
    knob = advisor.Knob(20.0, 2.5, 10.0, 22.5, watch=16, between=16, settle=16)
    # samples that pass of 8 in each chunk, guard samples, what the host does, what it sets
    rows = [
        (8, 0, None, None, "collecting", None, 20.0, []),
        (8, 0, None, None, "too_easy", 1, 20.0, ["suggested"]),
        (8, 0, None, None, "too_easy", 1, 20.0, []),
        (0, 0, 1.0, None, "collecting", None, 22.5, ["applied"]),
        (0, 0, None, None, "reversal", 2, 22.5, ["suggested"]),  # worse than before: back at once
        (5, 0, None, None, "too_strict", None, 22.5, None),
        (5, 8, None, None, "guard", None, 22.5, None),
        (8, 0, None, 12.5, "collecting", None, 12.5, ["changed_manually"]),
        (8, 0, 3.0, None, "equipment_settling", None, 12.5, ["equipment_change"]),
    ]
    counts = spark.createDataFrame([(1, i, 8.0, 8, 8, r[0], r[1]) for i, r in enumerate(rows)], "session_id long, chunk_id long, n double, n_train long, n_clean long, n_cond long, emg_n long")
    host = spark.createDataFrame([(1, i, r[2], r[3]) for i, r in enumerate(rows)], "session_id long, chunk_id long, act double, manual double")
    got = advisor.ledger(counts, knob, ["emg"], host).orderBy("chunk_id").collect()
    for g, (*_, reason, no, value, told) in zip(got[:5], rows[:5]):
        assert (g.reason, g.advice_id, g.value, g.told) == (reason, no, value, told)
    assert got[4].proposed == 20.0
    assert got[5].advice_id == 2 and got[5].told == []  # 5 of 16: still too low, the same advice stands
    assert got[6].reason == "guard" and got[6].told == ["blocked"]
    for g, (*_, reason, no, value, told) in zip(got[7:], rows[7:]):
        assert (g.reason, g.advice_id, g.value, g.told) == (reason, no, value, told)
    alone = advisor.ledger(counts, knob, ["emg"]).orderBy("chunk_id").collect()
    assert [g.told for g in alone[:4]] == [[], ["suggested"], [], ["superseded"]]


def test_dismissed_advice_waits_and_limits_hold(spark):
    knob = advisor.Knob(20.0, 2.5, 10.0, 20.0, watch=8, between=16, settle=8)
    counts = spark.createDataFrame([(s, i, 8.0, 8, 8, k, 0) for s, k in ((1, 0), (2, 8)) for i in range(5)], "session_id long, chunk_id long, n double, n_train long, n_clean long, n_cond long, emg_n long")
    host = spark.createDataFrame([(1, 1, 2.0, None)], "session_id long, chunk_id long, act double, manual double")
    got = advisor.ledger(counts, knob, ["emg"], host).orderBy("session_id", "chunk_id").collect()
    assert [g.reason for g in got] == ["too_strict", "cooldown", "too_strict", "too_strict", "too_strict"] + ["at_limit"] * 5
    assert [g.advice_id for g in got[:5]] == [1, None, 2, 2, 2]
    assert [g.told for g in got[:3]] == [["suggested"], ["dismissed"], ["suggested"]]
