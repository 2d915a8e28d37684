"""A query for each operator on the driver's tables, and the same in DuckDB SQL.

Signals: ``events.value`` by user (session), ordered by time; a rate of 16 Hz
and chunks of 8 samples are assumed. Montages use the number columns of
``lineitem`` as channels of an order. Values are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import custom, filters, montage
from .functions import expr as X
from .operators import host, kernels as K, outputs, runs, segments, trackers, windows
from .operators.samples import by_session, with_chunk, with_index, with_windows
from .plans import adviser, advisor, session
from .plans.protocol import Protocol, combined, fan_out
from .streaming.live import Live, Measure, run_live, state_store
from .streaming.processor import stream_kernels, stream_outputs

FS, CHUNK = 16.0, 8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SIG = """sig AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value AS x, event_type = 'click' AS artifact FROM events),
s AS (SELECT *, sample_idx // 8 AS chunk_id FROM sig)"""
W = "(PARTITION BY session_id ORDER BY sample_idx"
KEY = ["session_id", "sample_idx"]


def signal(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", F.col("value").alias("x"), (F.col("event_type") == "click").alias("artifact"))
    return with_chunk(with_index(e, "user_id", ["ts", "event_id"]).select(*KEY, "x", "artifact"), CHUNK)


def channels(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("Cz"), F.col("l_extendedprice").alias("Fz"), F.col("l_discount").alias("A1"), F.col("l_tax").alias("A2"))


CHANNELS = ["Cz", "Fz", "A1", "A2"]


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6) + 0.0


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def recursive(start: str, step: str, select: str, table: str = "", row: str = "") -> str:
    """SQL that steps a state along each session: s is the sample, r the state before it; ``row`` names one-row tables defined by ``table``."""
    return f"""WITH RECURSIVE {SIG}{table and ', ' + table}, r AS (SELECT session_id, sample_idx, {start} FROM s{row} WHERE sample_idx = 0
UNION ALL SELECT s.session_id, s.sample_idx, {step} FROM r JOIN s ON s.session_id = r.session_id AND s.sample_idx = r.sample_idx + 1{row})
SELECT session_id, sample_idx, {select} FROM r"""


# --- montages -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - l_extendedprice, 6) + 0.0 AS v FROM lineitem")
def montage_bipolar(spark, sf):
    return channels(spark, sf).select("l_orderkey", "l_linenumber", r6(montage.bipolar(CHANNELS, "Cz", "Fz")).alias("v"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity - (l_discount + l_tax) / 2, 6) + 0.0 AS ears, round(l_quantity - (l_quantity + l_extendedprice + l_discount + l_tax) / 4, 6) + 0.0 AS average,
round(l_quantity - l_extendedprice, 6) + 0.0 AS channel, round(l_quantity, 6) + 0.0 AS device FROM lineitem""")
def montage_referential(spark, sf):
    ref = lambda kind: r6(montage.referential(CHANNELS, "Cz", kind))
    return channels(spark, sf).select("l_orderkey", "l_linenumber", ref("linked_ears").alias("ears"), ref("common_average").alias("average"), ref("Fz").alias("channel"), ref("device").alias("device"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: abs(v::DOUBLE - list_sum(list_transform(embedding, lambda u: u::DOUBLE)) / len(embedding)))), 4) AS spread FROM embeddings""")
def montage_vector(spark, sf):
    v = montage.referential_vector(F.col("embedding"))
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("spread"))


@query("SELECT o_orderkey, round(o_totalprice, 6) AS v FROM orders")
def montage_passthrough(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("Cz"))
    return o.select("o_orderkey", r6(montage.passthrough(["Cz"])).alias("v"))


# --- expressions, predicates, transfer functions --------------------------------


@query(f"""WITH {SIG} SELECT session_id, sample_idx, round(x + 2, 6) + 0.0 AS plus, round(x - 50, 6) + 0.0 AS minus, round(x * 3, 6) + 0.0 AS times,
round(CASE WHEN sample_idx % 5 = 0 THEN 0.0 ELSE x / (sample_idx % 5) END, 6) + 0.0 AS ratio, round(-x, 6) + 0.0 AS negated, round(CASE WHEN x > 50 THEN x ELSE 0.0 END, 6) + 0.0 AS chosen FROM s""")
def arithmetic(spark, sf):
    x, n = F.col("x"), (F.col("sample_idx") % 5).cast("double")
    return signal(spark, sf).select(*KEY, r6(x + 2).alias("plus"), r6(x - 50).alias("minus"), r6(x * 3).alias("times"), r6(X.div(x, n)).alias("ratio"), r6(-x).alias("negated"), r6(X.choose(X.gt(x, F.lit(50.0)), x, F.lit(0.0))).alias("chosen"))


@query(f"""WITH {SIG} SELECT session_id, sample_idx, x > 60 AS above, x >= 60 AS at_or_above, x < 60 AS below, x BETWEEN 30 AND 90 AS inside, x > 30 AND x < 90 AS both, x < 30 OR x > 90 AS either, x = 60 AS equal, x <> 60 AS unequal FROM s""")
def predicates(spark, sf):
    x, k = F.col("x"), lambda v: F.lit(float(v))
    return signal(spark, sf).select(
        *KEY, X.above(x, k(60)).alias("above"), X.at_or_above(x, k(60)).alias("at_or_above"), X.below(x, k(60)).alias("below"), X.inside(x, k(30), k(90)).alias("inside"),
        X.all_of([X.gt(x, k(30)), X.lt(x, k(90))]).alias("both"), X.any_of([X.lt(x, k(30)), X.gt(x, k(90))]).alias("either"), X.eq(x, k(60)).alias("equal"), X.ne(x, k(60)).alias("unequal"),
    )


@query(f"""WITH {SIG} SELECT session_id, sample_idx, round(1 / (1 + exp(-0.05 * (x - 60))), 6) + 0.0 AS sigmoid, round(0.02 * (x - 60), 6) + 0.0 AS linear, round(abs(x - 60), 6) + 0.0 AS rectified,
round(sqrt(greatest(x - 60, 0)), 6) + 0.0 AS root, round(sqrt(x * x + 9), 6) + 0.0 AS magnitude FROM s""")
def transfer(spark, sf):
    x = F.col("x")
    return signal(spark, sf).select(*KEY, r6(X.sigmoid(x, 60.0, 0.05)).alias("sigmoid"), r6(X.linear(x, 60.0, 0.02)).alias("linear"), r6(X.rectify(x - 60)).alias("rectified"), r6(X.root(x - 60)).alias("root"), r6(X.magnitude(x, F.lit(3.0))).alias("magnitude"))


# --- windows ----------------------------------------------------------------------


@query(f"WITH {SIG} SELECT session_id, sample_idx, round((x - coalesce(lag(x, 2) OVER {W}), 0)) * 8, 6) + 0.0 AS d FROM s")
def differentiate(spark, sf):
    return with_windows(signal(spark, sf), 2, lambda w: {"d": r6(windows.differentiate(F.col("x"), FS, w))}).select(*KEY, "d")


def _fir_sql(taps, name="x") -> str:
    return " + ".join(f"({float(t)!r}) * coalesce(lag({name}, {j}) OVER {W}), 0)" for j, t in enumerate(taps) if t != 0.0)


_H, _E = filters.hilbert_taps(33), filters.envelope_taps(3.0, 5.0, FS, 0.5)


@query(f"""WITH {SIG}, h AS (SELECT *, coalesce(lag(x, 16) OVER {W}), 0) AS re, {_fir_sql(_H)} AS im FROM s)
SELECT session_id, sample_idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude FROM h""")
def hilbert(spark, sf):
    def cols(w):
        re, im = windows.hilbert(F.col("x"), _H, w)
        return {"re": re, "im": im}

    d = with_windows(signal(spark, sf), len(_H), cols)
    return d.select(*KEY, r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"), r6(X.magnitude(F.col("re"), F.col("im"))).alias("magnitude"))


@query(f"""WITH {SIG}, h AS (SELECT *, {_fir_sql(_E.real)} AS re, {_fir_sql(_E.imag)} AS im FROM s) SELECT session_id, sample_idx, round(sqrt(re * re + im * im), 6) + 0.0 AS envelope FROM h""")
def band_envelope(spark, sf):
    return with_windows(signal(spark, sf), len(_E), lambda w: {"envelope": windows.envelope(F.col("x"), _E, w)}).select(*KEY, r6(F.col("envelope")).alias("envelope"))


@query(f"WITH {SIG} SELECT session_id, sample_idx, round(quantile_cont(x, 0.7) OVER {W} ROWS 31 PRECEDING), 6) + 0.0 AS p FROM s")
def rolling_percentile(spark, sf):
    return with_windows(signal(spark, sf), 32, lambda w: {"p": windows.rolling_percentile(F.col("x"), 70.0, 32, w)}).select(*KEY, r6(F.col("p")).alias("p"))


@query(f"WITH {SIG} SELECT session_id, sample_idx, round(quantile_cont(x, 0.7) OVER {W} ROWS 47 PRECEDING), 6) + 0.0 AS p FROM s")
def rolling_percentile_long(spark, sf):
    return host.with_kernels(signal(spark, sf), [K.Percentile("x", "p", 70.0, 48)]).select(*KEY, r6(F.col("p")).alias("p"))


# Two minutes at 256 Hz.
MINUTES = 30_720


@query(f"""WITH sig AS (SELECT user_id % 2 AS session_id, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) - 1 AS sample_idx, value AS x FROM events)
SELECT session_id, sample_idx, round(quantile_cont(x, 0.7) OVER {W} ROWS {MINUTES - 1} PRECEDING), 6) + 0.0 AS p FROM sig""")
def percentile_two_minutes(spark, sf):
    """Windows of 30,720 samples over two long sessions, on segments that carry the rows their windows look back to."""
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 2).alias("half"), "ts", "event_id", F.col("value").alias("x"))
    s = with_index(e, "half", ["ts", "event_id"]).select(*KEY, "x")
    return segments.with_memory(s, MINUTES - 1, [K.Percentile("x", "p", 70.0, MINUTES)], 2 * MINUTES).select(*KEY, r6(F.col("p")).alias("p"))


@query(f"""WITH {SIG}, q AS (SELECT *, quantile_cont(x, 0.05) OVER {W} ROWS 31 PRECEDING) AS lo, quantile_cont(x, 0.95) OVER {W} ROWS 31 PRECEDING) AS hi FROM s)
SELECT session_id, sample_idx, round(least(greatest((x - lo) / greatest(hi - lo, 1e-9), 0), 1), 6) + 0.0 AS v FROM q""")
def auto_range(spark, sf):
    return with_windows(signal(spark, sf), 32, lambda w: {"v": windows.auto_range(F.col("x"), 32, w)}).select(*KEY, r6(F.col("v")).alias("v"))


@query(f"""WITH {SIG}, l AS (SELECT *, list(x) OVER {W} ROWS 23 PRECEDING) AS f FROM s), d AS (SELECT *, list_transform(f, lambda v: v - list_sum(f) / len(f)) AS d FROM l),
t AS (SELECT *, list_sum(list_transform(d, lambda v: v * v)) AS tot, list_sum(list_transform(range(1, len(d) - 2), lambda i: d[i] * d[i + 3])) AS num FROM d)
SELECT session_id, sample_idx, round(CASE WHEN len(f) < 5 OR tot <= 0 THEN 0 ELSE least(greatest(num / tot, -1), 1) END, 5) + 0.0 AS r FROM t""")
def autocorrelation(spark, sf):
    return with_windows(signal(spark, sf), 24, lambda w: {"r": windows.autocorrelation(F.col("x"), 3, 24, w)}).select(*KEY, (F.round("r", 5) + 0.0).alias("r"))


@query(f"WITH {SIG} SELECT session_id, sample_idx, round(avg(x) OVER {W} ROWS 15 PRECEDING), 6) + 0.0 AS m, round(avg((x BETWEEN 30 AND 90)::INT) OVER {W} ROWS 15 PRECEDING), 6) + 0.0 AS share FROM s")
def moving_mean(spark, sf):
    x = F.col("x")
    return with_windows(signal(spark, sf), 16, lambda w: {"m": windows.moving_mean(x, 16, w), "share": windows.fraction_in_range(x, 30.0, 90.0, 16, w)}).select(*KEY, r6(F.col("m")).alias("m"), r6(F.col("share")).alias("share"))


# --- recursions ---------------------------------------------------------------------

_A = "(1 - exp(-1 / (0.5 * 16)))"
_SMOOTH = recursive("x AS y", f"{_A} * s.x + (1 - {_A}) * r.y", "round(y, 6) + 0.0 AS y")


@query(_SMOOTH)
def smooth(spark, sf):
    return host.with_kernels(signal(spark, sf), [K.Smooth("x", "y", 0.5, FS)]).select(*KEY, r6(F.col("y")).alias("y"))


def _band(name: str, low: str, high: str) -> str:
    """A one-row table: the second-order Butterworth band-pass b0 (1 - z^-2) / (1 + a1 z^-1 + a2 z^-2) by the bilinear transform."""
    return f"""{name} AS (SELECT width * 32 / d AS b0, 2 * (square - 32 * 32) / d AS a1, (32 * 32 - width * 32 + square) / d AS a2 FROM (SELECT *, 32 * 32 + width * 32 + square AS d FROM (
SELECT hi - lo AS width, hi * lo AS square FROM (SELECT 32 * tan(pi() * {low} / 16) AS lo, 32 * tan(pi() * {high} / 16) AS hi))))"""


def _pole_pair(k: str, z: str, x: str, start: bool = False) -> str:
    """One step of _band's filter k; it starts as if x had been there forever."""
    z0, z1 = (f"(-{k}.b0 * {x})",) * 2 if start else (f"r.{z}0", f"r.{z}1")
    y = f"({k}.b0 * {x} + {z0})"
    return f"{y} AS {z}, {z1} - {k}.a1 * {y} AS {z}0, -{k}.b0 * {x} - {k}.a2 * {y} AS {z}1"


@query(recursive(_pole_pair("k", "y", "x", True), _pole_pair("k", "y", "s.x"), "round(y, 6) + 0.0 AS y", _band("k", "2.0", "4.0"), ", k"))
def bandpass(spark, sf):
    return host.with_kernels(signal(spark, sf), [K.Bandpass("x", "y", 2.0, 4.0, FS, order=1)]).select(*KEY, r6(F.col("y")).alias("y"))


def _cascade(kind: str, x: str, start: bool = False) -> str:
    """One step of a fourth-order band-pass: its sections one after the other."""
    sos, out = filters.bandpass_sos(2.0, 4.0, FS, 4, kind), []
    for i, ((b0, b1, b2, _, a1, a2), (w0, w1)) in enumerate(zip(sos.tolist(), filters.warm_state(sos).tolist())):
        z0, z1 = (f"({w0!r} * s.x)", f"({w1!r} * s.x)") if start else (f"r.{kind}{i}_0", f"r.{kind}{i}_1")
        y = f"(({b0!r}) * {x} + {z0})"
        out += [f"({b1!r}) * {x} - ({a1!r}) * {y} + {z1} AS {kind}{i}_0", f"({b2!r}) * {x} - ({a2!r}) * {y} AS {kind}{i}_1"]
        x = y
    return ", ".join([*out, f"{x} AS {kind}"])


_KINDS = ("butterworth", "bessel", "chebyshev2")


@query(recursive(", ".join(_cascade(k, "s.x", True) for k in _KINDS), ", ".join(_cascade(k, "s.x") for k in _KINDS), ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in _KINDS)))
def bandpass_kinds(spark, sf):
    ks = [K.Bandpass("x", n, 2.0, 4.0, FS, 4, n) for n in _KINDS]
    return host.with_kernels(signal(spark, sf), ks).select(*KEY, *[r6(F.col(k)).alias(k) for k in _KINDS])


@query(recursive(_cascade("butterworth", "s.x", True), _cascade("butterworth", "s.x"), f"round(avg(butterworth * butterworth) OVER {W} ROWS 15 PRECEDING), 6) + 0.0 AS p"))
def bandpower(spark, sf):
    return host.with_kernels(signal(spark, sf), [K.Bandpower("x", "p", 2.0, 4.0, 16, FS)]).select(*KEY, r6(F.col("p")).alias("p"))


# Segments of 8 samples (bins at 2, 4 and 6 Hz), 4 apart, in the last 32 samples of a chunk's end.
_COHERENCE = f"""WITH {SIG}, e AS (SELECT session_id, chunk_id, max(sample_idx) AS last, least(32, max(sample_idx) + 1) AS held FROM s GROUP BY ALL),
g AS (SELECT session_id, chunk_id, last - held + 1 + 4 * unnest(range(0, (held - 8) // 4 + 1)) AS first FROM e WHERE held >= 12),
v AS (SELECT g.session_id, g.chunk_id, first, sample_idx - first AS n, x - avg(x) OVER p AS a, sqrt(greatest(x, 0)) - avg(sqrt(greatest(x, 0))) OVER p AS b, 0.5 - 0.5 * cos(2 * pi() * (sample_idx - first) / 8) AS w
 FROM g JOIN s ON s.session_id = g.session_id AND sample_idx BETWEEN first AND first + 7 WINDOW p AS (PARTITION BY g.session_id, g.chunk_id, first)),
f AS (SELECT session_id, chunk_id, first, k, sum(a * w * cos(2 * pi() * k * n / 8)) AS ar, sum(-a * w * sin(2 * pi() * k * n / 8)) AS ai, sum(b * w * cos(2 * pi() * k * n / 8)) AS br, sum(-b * w * sin(2 * pi() * k * n / 8)) AS bi
 FROM v, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL),
m AS (SELECT session_id, chunk_id, k, (avg(ar * br + ai * bi) ** 2 + avg(ar * bi - ai * br) ** 2) / nullif(avg(ar * ar + ai * ai) * avg(br * br + bi * bi), 0) AS c FROM f GROUP BY ALL),
c AS (SELECT session_id, chunk_id, least(greatest(avg(coalesce(c, 0)), 0), 1) AS c FROM m GROUP BY ALL)
SELECT session_id, sample_idx, round(coalesce(c, 0), 5) AS c FROM s LEFT JOIN c USING (session_id, chunk_id)"""


@query(_COHERENCE)
def coherence(spark, sf):
    two = signal(spark, sf).withColumn("b", F.sqrt(F.greatest(F.col("x"), F.lit(0.0))))
    return host.with_kernels(two, [K.Coherence("x", "b", "c", 2.0, 6.0, 32, FS)]).select(*KEY, F.round("c", 5).alias("c"))


@query(ORACLE_SQL["smooth"])
def segmented_smooth(spark, sf):
    """The recursion of smooth on segments of 16 samples, whose affine maps are composed."""
    return segments.with_scan(signal(spark, sf), K.Smooth("x", "y", 0.5, FS), 16).select(*KEY, r6(F.col("y")).alias("y"))


@query(ORACLE_SQL["bandpass"])
def segmented_bandpass(spark, sf):
    return segments.with_scan(signal(spark, sf), K.Bandpass("x", "y", 2.0, 4.0, FS, order=1), 16).select(*KEY, r6(F.col("y")).alias("y"))


@query(ORACLE_SQL["rolling_percentile_long"])
def segmented_percentile(spark, sf):
    """Windows of 48 samples on segments of 64, each with the rows that its windows look back to."""
    return segments.with_memory(signal(spark, sf), 47, [K.Percentile("x", "p", 70.0, 48)], 64).select(*KEY, r6(F.col("p")).alias("p"))


@query(ORACLE_SQL["autocorrelation"])
def segmented_autocorrelation(spark, sf):
    """Running sums instead of a list of the window for each sample; on segments."""
    d = segments.with_memory(signal(spark, sf), 23, [K.Autocorrelation("x", "r", 3, 24)], 64)
    return d.select(*KEY, (F.round("r", 5) + 0.0).alias("r"))


_LONG = np.hanning(130)[1:-1] / np.hanning(130).sum()


@query(f"WITH {SIG} SELECT session_id, sample_idx, round({_fir_sql(_LONG)}, 6) + 0.0 AS y FROM s")
def long_fir(spark, sf):
    """128 taps by overlap-save on segments: one column in the plan, however many taps."""
    return segments.with_memory(signal(spark, sf), 127, [K.Fir("x", "y", _LONG)], 256).select(*KEY, r6(F.col("y")).alias("y"))


_TWO = {"slow": (1.5, 3.0), "fast": filters.band_edges(4.0, 2.0)}


@query(recursive(_pole_pair("k", "slow", "x", True) + ", " + _pole_pair("l", "fast", "x", True), _pole_pair("k", "slow", "s.x") + ", " + _pole_pair("l", "fast", "s.x"), "round(abs(slow), 6) + 0.0 AS slow, round(abs(fast), 6) + 0.0 AS fast", _band("k", "1.5", "3.0") + ", " + _band("l", "4 / sqrt(2)", "4 * sqrt(2)"), ", k, l"))
def band_fan_out(spark, sf):
    """One stream for each band of a table; the second band is given by its centre and ratio."""

    def build(p: Protocol, at: str, low: float, high: float) -> None:
        p.kernel(K.Bandpass("x", f"y{at}", low, high, FS, order=1)).stream(f"env{at}", X.rectify(F.col(f"y{at}")))

    d = Protocol(FS, CHUNK).bands(_TWO, build).apply(signal(spark, sf))
    return d.select(*KEY, *[r6(F.col(f"env@{b}")).alias(b) for b in _TWO])


# --- run lengths, gates -----------------------------------------------------------------

_DWELL = f"""i AS (SELECT *, x > 40 AS c, max(CASE WHEN NOT x > 40 THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) AS f FROM s), d AS (SELECT *, CASE WHEN c THEN sample_idx - coalesce(f, -1) ELSE 0 END AS k FROM i)"""


@query(f"WITH {SIG}, {_DWELL} SELECT session_id, sample_idx, k >= 3 AS d_holds, k = 3 AS d_event FROM d")
def dwell(spark, sf):
    return runs.with_dwell(signal(spark, sf), X.gt(F.col("x"), F.lit(40.0)), 3, "d").select(*KEY, "d_holds", "d_event")


_C, _OK = "(s.x > 40)", "(NOT s.artifact)"
_STEP = lambda streak, dip: f"""CASE WHEN NOT {_OK} THEN {streak} WHEN {_C} THEN {streak} + 1 WHEN {dip} + 1 > 2 THEN 0 ELSE {streak} END AS streak, CASE WHEN NOT {_OK} THEN {dip} WHEN {_C} THEN 0 ELSE {dip} + 1 END AS dip"""


@query(recursive(_STEP("0", "0"), _STEP("r.streak", "r.dip"), f"streak >= 4 AS d_holds, streak >= 4 AND NOT coalesce(lag(streak >= 4) OVER {W}), false) AS d_event"))
def dwell_tolerant(spark, sf):
    """Dips of two samples are bridged; artifact samples freeze the streak."""
    s = signal(spark, sf).withColumn("c", X.gt(F.col("x"), F.lit(40.0))).withColumn("ok", ~F.col("artifact"))
    return host.with_kernels(s, [K.Dwell("c", "d", 4, 2, "ok")]).select(*KEY, "d_holds", "d_event")


@query(f"WITH {SIG}, {_DWELL} SELECT session_id, sample_idx, k >= 5 AS h_holds FROM d")
def hold_for(spark, sf):
    return runs.with_dwell(signal(spark, sf), X.gt(F.col("x"), F.lit(40.0)), 5, "h").select(*KEY, "h_holds")


def _rearm(streak: str, away: str, armed: str) -> str:
    k, a = f"(CASE WHEN {_C} THEN {streak} + 1 ELSE 0 END)", f"(CASE WHEN {_C} THEN 0 ELSE {away} + 1 END)"
    ready = f"({armed} OR {a} >= 2)"
    fire = f"({k} >= 2 AND {ready})"
    return f"{k} AS streak, {a} AS away, {ready} AND NOT {fire} AS armed, {fire} AS fire"


@query(recursive(_rearm("0", "0", "true"), _rearm("r.streak", "r.away", "r.armed"), "streak >= 2 AS d_holds, fire AS d_event"))
def dwell_rearm(spark, sf):
    s = signal(spark, sf).withColumn("c", X.gt(F.col("x"), F.lit(40.0)))
    return host.with_kernels(s, [K.DwellRearm("c", "d", 2, 2)]).select(*KEY, "d_holds", "d_event")


_GATE = f"""g AS (SELECT *, x > 90 AS a, max(CASE WHEN x > 90 THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) AS l, max(CASE WHEN artifact THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) AS m FROM s)"""


@query(f"WITH {SIG}, {_GATE} SELECT session_id, sample_idx, a AS loud_active, coalesce(sample_idx - l <= 3, false) AS loud_gated, a AS told_active, coalesce(sample_idx - l <= 3, false) AS muted FROM g")
def inhibits(spark, sf):
    """mute with a release of default length (3 samples at 16 Hz), and a flag, which gates nothing."""
    p = Protocol(FS, CHUNK).inhibit("loud", "x", F.lit(90.0)).inhibit("told", "x", F.lit(90.0), "flag")
    return p.apply(signal(spark, sf)).select(*KEY, "loud_active", "loud_gated", "told_active", p.muted().alias("muted"))


@query(f"""WITH {SIG}, {_GATE} SELECT session_id, sample_idx, coalesce(sample_idx - l <= 3, false) AS frozen, coalesce(sample_idx - m <= 1, false) AS artifact_muted FROM g""")
def freeze_and_artifacts(spark, sf):
    p = Protocol(FS, CHUNK).stream("art", F.col("artifact").cast("double")).inhibit("loud", "x", F.lit(90.0), "freeze", 0.0).inhibit("bad", "art", F.lit(0.5), "mute", 62.5, artifact=True)
    return p.apply(signal(spark, sf)).select(*KEY, F.col("loud_gated").alias("frozen"), p.muted(artifacts=True).alias("artifact_muted"))


@query(f"""WITH {SIG}, g AS (SELECT *, sum(1) OVER {W} ROWS UNBOUNDED PRECEDING) AS k FROM s WHERE NOT chunk_id BETWEEN 2 AND 4),
h AS (SELECT session_id, sample_idx, coalesce(k - max(CASE WHEN x > 90 THEN k END) OVER {W} ROWS UNBOUNDED PRECEDING) <= 3, false) AS loud FROM g),
q AS (SELECT *, coalesce(sample_idx - max(CASE WHEN x < 5 THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) <= 3, false) AS quiet FROM s)
SELECT session_id, sample_idx, coalesce(loud, false) AS loud_gated, quiet AS quiet_gated, coalesce(loud, false) OR quiet AS muted FROM q LEFT JOIN h USING (session_id, sample_idx)""")
def block_gates(spark, sf):
    """The training phase's block lets only one inhibit gate; the other's hangover waits until the phase ends."""
    phases = [session.Phase("warmup", 12, True), session.Phase("train", 24, inhibits=("quiet",)), session.Phase("more", None)]
    d = session.with_phase(signal(spark, sf), phases, CHUNK).withColumn("low", -F.col("x"))
    p = Protocol(FS, CHUNK).inhibit("loud", "x", F.lit(90.0), where=session.allows(phases, "loud")).inhibit("quiet", "low", F.lit(-5.0), where=session.allows(phases, "quiet"))
    return p.apply(d).select(*KEY, "loud_gated", "quiet_gated", p.muted().alias("muted"))


# --- reward, outputs ---------------------------------------------------------------------


@query(f"""WITH {SIG} SELECT session_id, sample_idx, round((0.5 * least(greatest(x / 97, 0), 1) + 0.25 * (1 - least(greatest(x / 193, 0), 1)) + 0.25 * (sample_idx % 2)) / 1.0, 6) + 0.0 AS reward FROM s""")
def composite_reward(spark, sf):
    x = F.col("x")
    return signal(spark, sf).select(*KEY, r6(X.composite([(x / 97, 0.5, False), (x / 193, 0.25, True), ((F.col("sample_idx") % 2).cast("double"), 0.25, False)])).alias("reward"))


@query(f"""WITH {SIG}, c AS (SELECT *, x > 30 AS c0, x < 120 AS c1, x > 30 AND x < 120 AS c FROM s), f AS (SELECT *, max(CASE WHEN NOT c THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) AS f FROM c)
SELECT session_id, sample_idx, c0 AS reward_condition_0, c1 AS reward_condition_1, c AND sample_idx - coalesce(f, -1) = 3 AS d_event FROM f""")
def reward_conditions(spark, sf):
    """The parts of a reward's condition stay readable beside its event."""
    x = F.col("x")
    p = Protocol(FS, CHUNK).conditions("reward", [X.gt(x, F.lit(30.0)), X.lt(x, F.lit(120.0))]).dwell("d", F.col("reward"), 3)
    return p.apply(signal(spark, sf)).select(*KEY, "reward_condition_0", "reward_condition_1", "d_event")


class PeakHold(K.Kernel):
    """The largest sample so far, which decays; an example of a custom kernel."""

    memory = ("peak",)

    def __init__(self, x: str, out: str, decay: float):
        self.inputs, self.outputs, self.decay, self.peak = [x], {out: "double"}, decay, None

    def step(self, c):
        out = []
        for v in c[self.inputs[0]].tolist():
            self.peak = v if self.peak is None else max(v, self.peak * self.decay)
            out.append(self.peak)
        return {next(iter(self.outputs)): np.array(out)}


def reward_protocol() -> Protocol:
    """Rectify, rolling percentile, dwell above it, sigmoid of the ratio; muted by a loud inhibit."""
    p = Protocol(FS, CHUNK).stream("env", X.rectify(F.col("x")))
    p.window(32, lambda w: {"thr": windows.rolling_percentile(F.col("env"), 70.0, 32, w)})
    p.inhibit("loud", "x", F.lit(150.0))
    p.dwell("reward", X.above(F.col("env"), F.col("thr")), 2)
    p.analog("audio_gain", X.sigmoid(X.div(F.col("env"), F.col("thr")), 1.0, 4.0)).event("audio_chime", F.col("reward_event"))
    return p


_REWARD = f"""e AS (SELECT *, quantile_cont(abs(x), 0.7) OVER {W} ROWS 31 PRECEDING) AS thr, coalesce(sample_idx - max(CASE WHEN x > 150 THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) <= 3, false) AS muted FROM s),
c AS (SELECT *, max(CASE WHEN NOT abs(x) > thr THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) AS f FROM e),
v AS (SELECT *, CASE WHEN abs(x) > thr THEN sample_idx - coalesce(f, -1) ELSE 0 END AS k, 1 / (1 + exp(-4 * ((CASE WHEN thr = 0 THEN 0 ELSE abs(x) / thr END) - 1))) AS gain FROM c)"""


@query(f"""WITH {SIG}, {_REWARD} SELECT session_id, min(sample_idx) / 16.0::DOUBLE AS timestamp_s, 'audio_gain' AS channel, 'value' AS kind, round(avg(CASE WHEN muted THEN 0 ELSE gain END), 6) + 0.0 AS value FROM v GROUP BY session_id, chunk_id
UNION ALL SELECT session_id, sample_idx / 16.0::DOUBLE, 'audio_chime', 'event', NULL FROM v WHERE k = 2 AND NOT muted""")
def reward_outputs(spark, sf):
    return reward_protocol().emit(signal(spark, sf)).withColumn("value", r6(F.col("value")))


@query(f"""WITH {SIG}, {_REWARD} SELECT session_id, chunk_id, round(max_by(abs(x), sample_idx), 6) + 0.0 AS env, round(max_by(thr, sample_idx), 6) + 0.0 AS thr, max((k = 2)::INT)::DOUBLE AS reward_event, max(muted::INT)::DOUBLE AS muted FROM v GROUP BY ALL""")
def taps(spark, sf):
    d = reward_protocol().apply(signal(spark, sf))
    t = outputs.taps(d, {"env": "env", "thr": "thr"}, {"reward_event": "reward_event", "muted": "loud_gated"})
    return t.withColumn("env", r6(F.col("env"))).withColumn("thr", r6(F.col("thr")))


# --- sessions, controls, seeds ---------------------------------------------------------------

PHASES = [session.Phase("warmup", 12, True), session.Phase("train", 24, False, "smr"), session.Phase("rest", 8, True), session.Phase("more", None, False, "theta")]
_PHASE = "p(phase_index, phase, phase_muted, bundle, a, b) AS (VALUES (0, 'warmup', true, NULL, 0, 2), (1, 'train', false, 'smr', 2, 5), (2, 'rest', true, NULL, 5, 6), (3, 'more', false, 'theta', 6, 1000000000))"


@query(f"WITH {SIG}, {_PHASE} SELECT session_id, sample_idx, phase_index, phase, phase_muted, bundle, round(CASE WHEN phase_muted THEN 0 WHEN bundle = 'smr' THEN x ELSE 2 * x END, 6) + 0.0 AS reward FROM s JOIN p ON chunk_id >= a AND chunk_id < b")
def phases_and_bundles(spark, sf):
    d = session.with_phase(signal(spark, sf), PHASES, CHUNK)
    reward = F.when(F.col("phase_muted"), 0.0).when(F.col("bundle") == "smr", F.col("x")).otherwise(2 * F.col("x"))
    return d.select(*KEY, "phase_index", "phase", "phase_muted", "bundle", r6(reward).alias("reward"))


@query(f"""WITH {SIG}, {_PHASE}, j AS (SELECT s.*, phase_index, phase_muted, phase_muted AND phase_index > 0 AS frozen FROM s JOIN p ON chunk_id >= a AND chunk_id < b),
k AS (SELECT *, quantile_cont(x, 0.6) OVER {W} ROWS 15 PRECEDING) AS q FROM j WHERE NOT frozen)
SELECT session_id, sample_idx, round(last_value(q IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS thr FROM j LEFT JOIN k USING (session_id, sample_idx)""")
def rest_freeze(spark, sf):
    """A threshold stops ingesting in muted phases after the first."""
    d = session.with_phase(signal(spark, sf), PHASES, CHUNK).withColumn("on", ~(F.col("phase_muted") & (F.col("phase_index") > 0)))
    return host.with_kernels(d, [K.Percentile("x", "thr", 60.0, 16, ingest="on")]).select(*KEY, r6(F.col("thr")).alias("thr"))


_TIMELINE = "t AS (SELECT DISTINCT session_id, chunk_id, 'gain' AS name, 1 + (session_id + chunk_id) % 7 AS value FROM s WHERE chunk_id % 3 = 1)"


@query(f"WITH {SIG}, {_TIMELINE} SELECT session_id, sample_idx, coalesce(t.value, 0.5)::DOUBLE AS gain, round(x * coalesce(t.value, 0.5), 6) + 0.0 AS y FROM s ASOF LEFT JOIN t ON s.session_id = t.session_id AND s.chunk_id >= t.chunk_id".replace("SELECT session_id, sample_idx, coalesce", "SELECT s.session_id, sample_idx, coalesce"))
def live_controls(spark, sf):
    s = signal(spark, sf)
    timeline = s.filter(F.col("chunk_id") % 3 == 1).select("session_id", "chunk_id", F.lit("gain").alias("name"), (1 + (F.col("session_id") + F.col("chunk_id")) % 7).cast("double").alias("value")).distinct()
    d = session.with_controls(s, timeline, {"gain": 0.5})
    return d.select(*KEY, "gain", r6(F.col("x") * F.col("gain")).alias("y"))


@query(f"""WITH {SIG}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample_idx DESC) AS r FROM s WHERE chunk_id < 2)
SELECT session_id, round(quantile_cont(x, 0.75) * 1.2, 6) + 0.0 AS seed, count(*) AS seed_samples, count(*) = 12 AS seeded FROM k WHERE r <= 12 GROUP BY session_id""")
def warmup_seeds(spark, sf):
    return session.seeds(signal(spark, sf), F.col("x"), F.col("chunk_id") < 2, 75.0, 12, 1.2).withColumn("seed", r6(F.col("seed")))


_SEED = "q AS (SELECT session_id, quantile_cont(x, 0.75) * 1.2 AS seed, count(*) = 12 AS whole FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample_idx DESC) AS r FROM s WHERE chunk_id < 2 AND NOT artifact) WHERE r <= 12 GROUP BY session_id)"


@query(f"""WITH {SIG}, {_SEED}, t AS (SELECT session_id, chunk_id, (50 + session_id % 9)::DOUBLE AS value FROM s WHERE (session_id + 3 * chunk_id) % 8 = 1 GROUP BY ALL),
o AS (SELECT session_id, bool_or(chunk_id <= 2) AS early FROM t GROUP BY ALL),
j AS (SELECT s.session_id, sample_idx, s.chunk_id >= 2 AND NOT coalesce(early, false) AS run, seed, whole, t.value FROM s ASOF LEFT JOIN t ON s.session_id = t.session_id AND s.chunk_id >= t.chunk_id LEFT JOIN o ON o.session_id = s.session_id LEFT JOIN q ON q.session_id = s.session_id)
SELECT session_id, sample_idx, round(CASE WHEN value IS NOT NULL THEN value WHEN run AND whole THEN seed ELSE 70 END, 6) + 0.0 AS thr, run AND NOT coalesce(whole, false) AS seed_muted FROM j""")
def seeded_control(spark, sf):
    """A threshold takes its seed when the warm-up ends, unless the host has set it; sessions without a whole seed stay muted."""
    s = signal(spark, sf)
    got = session.seeds(s, F.col("x"), (F.col("chunk_id") < 2) & ~F.col("artifact"), 75.0, 12, 1.2)
    host_ = s.filter((F.col("session_id") + 3 * F.col("chunk_id")) % 8 == 1).select("session_id", "chunk_id", F.lit("thr").alias("name"), (50 + F.col("session_id") % 9).cast("double").alias("value")).distinct()
    return session.with_seed(s, got, host_, "thr", 70.0, 2).select(*KEY, r6(F.col("thr")).alias("thr"), "seed_muted")


FLOORED = [session.Phase("warmup", 12, True), session.Phase("train", 16, False, "smr", floor=True), session.Phase("rest", 8, True), session.Phase("more", None, False, "theta")]


def _walk(src: str, i: str, e: str, held: str, frozen: str) -> str:
    """A chunk's phase under commands (FLOORED), and the state after it."""
    return f"""SELECT session_id, chunk_id, CASE WHEN j < 4 THEN j ELSE -1 END AS place, j + due::INT AS i, CASE WHEN due THEN 0 ELSE t END AS e, held AND NOT due AS held, frozen FROM (
SELECT *, coalesce(NOT frozen AND NOT held AND t >= dur, false) AS due FROM (SELECT *, CASE WHEN frozen THEN e0 ELSE e0 + n END AS t FROM (
SELECT session_id, chunk_id, n, j, e0, [12, 16, 8, NULL][j + 1] AS dur, CASE WHEN j = 1 THEN coalesce(hold, h0) ELSE h0 END AS held, coalesce(stopped, f0) AS frozen FROM (
SELECT c.*, {i} + (adv AND {i} < 4)::INT AS j, CASE WHEN adv AND {i} < 4 THEN 0 ELSE {e} END AS e0, {held} AND NOT (adv AND {i} < 4) AS h0, {frozen} AS f0 FROM {src}))))"""


@query(f"""WITH RECURSIVE {SIG}, c AS (SELECT session_id, chunk_id, count(*) AS n, min(sample_idx) AS first, (session_id + 3 * chunk_id) % 11 = 4 AS adv,
 CASE (session_id + chunk_id) % 5 WHEN 0 THEN true WHEN 1 THEN false END AS hold, CASE (session_id + 2 * chunk_id) % 7 WHEN 2 THEN true WHEN 3 THEN false END AS stopped FROM s GROUP BY ALL),
r AS ({_walk("c WHERE c.chunk_id = 0", "0", "0", "false", "false")} UNION ALL {_walk("r JOIN c ON c.session_id = r.session_id AND c.chunk_id = r.chunk_id + 1", "r.i", "r.e", "r.held", "r.frozen")}),
g AS (SELECT *, coalesce(sample_idx - max(CASE WHEN x > 90 THEN sample_idx END) OVER {W} ROWS UNBOUNDED PRECEDING) <= 3, false) AS muted FROM s),
h AS (SELECT g.session_id, sample_idx, place, sample_idx = first AND coalesce(stopped, false) AS reset, x > 40 AND NOT muted AND place NOT IN (0, 2) AS ok FROM g JOIN r USING (session_id, chunk_id) JOIN c USING (session_id, chunk_id) WHERE place >= 0),
b AS (SELECT *, max(CASE WHEN NOT ok THEN sample_idx WHEN reset THEN sample_idx - 1 END) OVER {W} ROWS UNBOUNDED PRECEDING) AS last FROM h)
SELECT session_id, sample_idx, place AS phase_index, ['warmup', 'train', 'rest', 'more'][place + 1] AS phase, place IN (0, 2) AS phase_muted, reset AS hold_reset, ok AND sample_idx - coalesce(last, -1) >= 3 AS h_holds FROM b""")
def host_commands(spark, sf):
    """A host advances phases, holds one past its floor and freezes the clock, which starts held outputs anew; muted samples break them."""
    s = signal(spark, sf)
    at = F.col("session_id"), F.col("chunk_id")
    hold, freeze = (at[0] + at[1]) % 5, (at[0] + 2 * at[1]) % 7
    rows = {"advance": F.when((at[0] + 3 * at[1]) % 11 == 4, 1.0), "hold": F.when(hold == 0, 1.0).when(hold == 1, 0.0), "freeze": F.when(freeze == 2, 1.0).when(freeze == 3, 0.0)}
    told = s.select(*at).distinct().select(*at, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in rows.items()]))).filter("value is not null")
    p = Protocol(FS, CHUNK).inhibit("loud", "x", F.lit(90.0))
    p.output_hold("h", X.gt(F.col("x"), F.lit(40.0)), 3, suppressed=F.col("phase_muted"), reset=F.col("hold_reset"))
    return p.apply(session.with_commands(s, FLOORED, told)).select(*KEY, F.col("phase_index").cast("long").alias("phase_index"), "phase", "phase_muted", "hold_reset", "h_holds")


@query(f"""WITH {SIG}, k AS (SELECT *, chunk_id // 2 AS b, row_number() OVER (PARTITION BY session_id, chunk_id // 2 ORDER BY sample_idx DESC) AS r FROM s WHERE NOT artifact)
SELECT session_id, b + 1 AS block, CASE WHEN count(*) = 6 THEN round(quantile_cont(x, 0.5), 6) + 0.0 END AS reseed FROM k WHERE r <= 6 GROUP BY session_id, b""")
def block_reseeds(spark, sf):
    return session.reseeds(signal(spark, sf), F.col("x"), F.floor(F.col("chunk_id") / 2), ~F.col("artifact"), 50.0, 6).withColumn("reseed", r6(F.col("reseed")))


@query(f"""WITH RECURSIVE {SIG}, k AS (SELECT *, chunk_id // 2 AS b, count(*) FILTER (NOT artifact) OVER {W} ROWS UNBOUNDED PRECEDING) AS c FROM s),
e AS (SELECT session_id, b, max(c) AS upto FROM k GROUP BY ALL),
r AS (SELECT session_id, b, upto, 0::BIGINT AS used, false AS wrote FROM e WHERE b = 0
UNION ALL SELECT e.session_id, e.b, e.upto, CASE WHEN r.upto - r.used >= 20 THEN r.upto ELSE r.used END, r.upto - r.used >= 20 FROM r JOIN e ON e.session_id = r.session_id AND e.b = r.b + 1),
v AS (SELECT r.session_id, r.b, quantile_cont(x, 0.5) * 1.1 AS value FROM r JOIN k ON k.session_id = r.session_id AND NOT k.artifact AND k.c <= r.used AND k.c > r.used - 20 WHERE wrote GROUP BY ALL),
t AS (SELECT session_id, chunk_id, (50 + session_id % 9)::DOUBLE AS told FROM s WHERE (session_id + 3 * chunk_id) % 16 = 1 GROUP BY ALL),
h AS (SELECT session_id, min(chunk_id) AS host FROM t GROUP BY ALL),
j AS (SELECT k.*, v.b AS vb, CASE WHEN v.value IS NOT NULL AND (host IS NULL OR k.chunk_id < host) THEN least(greatest(v.value, 30), 90) END AS own, told FROM k ASOF LEFT JOIN v ON k.session_id = v.session_id AND k.b >= v.b ASOF LEFT JOIN t ON k.session_id = t.session_id AND k.chunk_id >= t.chunk_id LEFT JOIN h ON h.session_id = k.session_id)
SELECT session_id, sample_idx, round(coalesce(own, told, 70), 6) + 0.0 AS thr, own IS NOT NULL AND sample_idx = 16 * vb AS hold_reset FROM j""")
def reseeded_control(spark, sf):
    """A threshold measured anew at each block that finds enough fresh samples; else it stays, and the host's word ends it."""
    s = signal(spark, sf)
    host_ = s.filter((F.col("session_id") + 3 * F.col("chunk_id")) % 16 == 1).select("session_id", "chunk_id", F.lit("thr").alias("name"), (50 + F.col("session_id") % 9).cast("double").alias("value")).distinct()
    d = session.with_controls(s, host_, {"thr": 70.0})
    out = session.with_reseeds(d, host_, "thr", F.col("x"), F.floor(F.col("chunk_id") / 2), ~F.col("artifact"), 50.0, 20, 1.1, 30.0, 90.0)
    return out.select(*KEY, r6(F.col("thr")).alias("thr"), "hold_reset")


@query(f"""WITH RECURSIVE {SIG}, {_SEED}, t AS (SELECT session_id, min(chunk_id) AS host FROM s WHERE (session_id + 3 * chunk_id) % 16 = 1 GROUP BY ALL), a AS (SELECT session_id, min(sample_idx) FILTER (chunk_id >= 2) AS began FROM s GROUP BY ALL),
b AS (SELECT a.session_id, began, host, seed, whole, CASE WHEN began IS NULL THEN 'pending' WHEN host <= 2 THEN 'disarmed' WHEN whole THEN 'fired' ELSE 'failed' END AS status FROM a LEFT JOIN q USING (session_id) LEFT JOIN t USING (session_id)),
k AS (SELECT *, chunk_id // 2 AS b, count(*) FILTER (NOT artifact) OVER {W} ROWS UNBOUNDED PRECEDING) AS c FROM s), e AS (SELECT session_id, b, max(c) AS upto FROM k GROUP BY ALL),
r AS (SELECT session_id, b, upto, 0::BIGINT AS used, false AS wrote FROM e WHERE b = 0
UNION ALL SELECT e.session_id, e.b, e.upto, CASE WHEN r.upto - r.used >= 20 THEN r.upto ELSE r.used END, r.upto - r.used >= 20 FROM r JOIN e ON e.session_id = r.session_id AND e.b = r.b + 1),
w AS (SELECT r.session_id, r.b, quantile_cont(x, 0.75) * 1.2 AS v FROM r JOIN k ON k.session_id = r.session_id AND NOT k.artifact AND k.c <= r.used AND k.c > r.used - 20 WHERE wrote GROUP BY ALL),
h AS (SELECT session_id, began AS i, CASE WHEN status = 'fired' THEN seed END AS v FROM b WHERE status IN ('fired', 'failed') UNION ALL SELECT w.session_id, 16 * w.b, v FROM w JOIN b USING (session_id) WHERE status = 'fired' AND 2 * w.b > 2 AND (host IS NULL OR 2 * w.b < host)),
g AS (SELECT session_id, max_by(coalesce(v, -1), i) AS last, max(i) AS began, count(*) AS n, string_agg(coalesce(round(v, 4)::DECIMAL(20, 4)::VARCHAR, 'none'), ',' ORDER BY i) AS said FROM h GROUP BY ALL)
SELECT session_id, status, round(CASE WHEN last <> -1 THEN last END, 6) + 0.0 AS value, g.began / 16.0::DOUBLE AS at_time_s, coalesce(n, 0) AS records, coalesce(said, '') AS history FROM b LEFT JOIN g USING (session_id)""")
def seed_reports(spark, sf):
    """Status, value and history of a control that is seeded after the warm-up and measured anew at blocks."""
    s = signal(spark, sf)
    clean, x = ~F.col("artifact"), F.col("x")
    got = session.seeds(s, x, (F.col("chunk_id") < 2) & clean, 75.0, 12, 1.2)
    host_ = s.filter((F.col("session_id") + 3 * F.col("chunk_id")) % 16 == 1).select("session_id", "chunk_id", F.lit("thr").alias("name"), F.lit(60.0).alias("value")).distinct()
    writes = session.reseed_writes(s, x, F.floor(F.col("chunk_id") / 2), clean, 75.0, 20, 1.2)
    r = session.seed_report(s, "thr", "x", got, host_, 2, 75.0, 12, 1.2, FS, writes)
    said = F.array_join(F.transform("history", lambda h: F.coalesce(F.round(h["new_value"], 4).cast("decimal(20,4)").cast("string"), F.lit("none"))), ",")
    return r.select("session_id", "status", r6(F.col("value")).alias("value"), "at_time_s", F.size("history").cast("long").alias("records"), said.alias("history"))


_LIVE = lambda y, k, live, last: f"""{y} AS y, CASE WHEN NOT s.x > 40 THEN 0 WHEN {live} <> {last} THEN 1 ELSE {k} + 1 END AS k, {live} AS live"""
_TAU, _COUNT = "(CASE WHEN s.chunk_id % 3 = 0 THEN 0.5 ELSE 0.125 END)", "(2 + s.chunk_id // 2 % 2)"


@query(recursive(_LIVE("s.x", "0", _COUNT, "2"), _LIVE(f"r.y + (1 - exp(-1 / ({_TAU} * 16))) * (s.x - r.y)", "r.k", _COUNT, "r.live"), "round(y, 6) + 0.0 AS y, k >= live AS d_holds"))
def live_retuning(spark, sf):
    """A smoothing time and a hold's duration that controls change: the average goes on from where it is, the hold starts anew."""
    s = signal(spark, sf).withColumn("c", X.gt(F.col("x"), F.lit(40.0)))
    s = s.withColumn("tau", F.when(F.col("chunk_id") % 3 == 0, 0.5).otherwise(0.125)).withColumn("n", 2.0 + F.floor(F.col("chunk_id") / 2) % 2)
    return host.with_kernels(s, [K.Smooth("x", "y", 1.0, FS, "tau"), K.Dwell("c", "d", 2, count_column="n")]).select(*KEY, r6(F.col("y")).alias("y"), "d_holds")


@query(f"""WITH {SIG}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample_idx DESC) AS r FROM s), t AS (SELECT session_id, quantile_cont(x, 0.7) AS value, count(*) AS n_eff FROM l WHERE r <= 32 GROUP BY session_id)
SELECT session_id, round(value, 6) + 0.0 AS value, 70.0::DOUBLE AS target_pct, n_eff FROM t""")
def tracker_state(spark, sf):
    """What a percentile tracker exports at the end of each session, to seed the next."""
    got = trackers.snapshots(signal(spark, sf), K.Percentile("x", "p", 70.0, 32))
    return got.select("session_id", r6(F.col("value")).alias("value"), "target_pct", F.col("n_eff").cast("long").alias("n_eff"))


_REFILL = "CASE WHEN s.sample_idx % 24 = 0 THEN list_transform(range(len(r.held)), lambda i: r.v) ELSE r.held END"


@query(f"""WITH RECURSIVE {SIG}, r AS (SELECT session_id, sample_idx, [x] AS held, x AS v, NULL::DOUBLE AS begun FROM s WHERE sample_idx = 0
UNION ALL SELECT session_id, sample_idx, held, list_aggregate(held, 'quantile_cont', 0.7) AS v, begun FROM (
 SELECT s.session_id, s.sample_idx, list_append({_REFILL}, s.x)[-16:] AS held, CASE WHEN s.sample_idx % 24 = 0 THEN r.v ELSE r.begun END AS begun FROM r JOIN s ON s.session_id = r.session_id AND s.sample_idx = r.sample_idx + 1))
SELECT session_id, sample_idx, round(v, 6) + 0.0 AS p, round(begun, 6) + 0.0 AS p_start FROM r""")
def carried_tracker(spark, sf):
    """A client's visits of 24 samples: each visit's threshold starts from what the last one exported."""
    s = signal(spark, sf).withColumn("visit", F.floor(F.col("sample_idx") / 24))
    d = host.with_kernels(s, [trackers.Visits(K.Percentile("x", "p", 70.0, 16), "visit")])
    return d.select(*KEY, r6(F.col("p")).alias("p"), r6(F.col("p_start")).alias("p_start"))


# The last 16 samples of each session's first half, then the ranks of its second half among them and what has come since.
_HALF = "CASE WHEN s.sample_idx = r.half THEN list_transform(range(len(r.held)), lambda i: CASE WHEN len(r.held) = 1 THEN r.lo ELSE r.lo + i * (r.hi - r.lo) / (len(r.held) - 1) END) ELSE r.held END"


@query(f"""WITH RECURSIVE {SIG}, n AS (SELECT session_id, count(*) // 2 AS half FROM s GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT session_id, sample_idx, half, [x] AS held, x AS lo, x AS hi, x FROM s JOIN n USING (session_id) WHERE sample_idx = 0
UNION ALL SELECT session_id, sample_idx, half, held, list_aggregate(held, 'quantile_cont', 0.05) AS lo, list_aggregate(held, 'quantile_cont', 0.95) AS hi, x FROM (
 SELECT s.session_id, s.sample_idx, r.half, list_append({_HALF}, s.x)[-16:] AS held, s.x FROM r JOIN s ON s.session_id = r.session_id AND s.sample_idx = r.sample_idx + 1))
SELECT session_id, sample_idx, round(least(greatest((x - lo) / greatest(hi - lo, 1e-9), 0), 1), 6) + 0.0 AS v FROM r WHERE sample_idx >= half""")
def started_range(spark, sf):
    """The second half of each session as a session of its own, whose auto range starts from a snapshot table of first halves."""
    s = signal(spark, sf)
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy("session_id")) / 2)
    s = s.withColumn("half", half)
    got = trackers.snapshots(s.filter("sample_idx < half"), K.AutoRange("x", "v", 16))
    later = trackers.with_start(s.filter("sample_idx >= half and half > 0"), got, ("low", "high", "n_eff"))
    return host.with_kernels(later, [K.AutoRange("x", "v", 16, start=("low", "high", "n_eff"))]).select(*KEY, r6(F.col("v")).alias("v"))


# --- advice, fan-out ------------------------------------------------------------------------------

_BUCKET = f"b AS (SELECT session_id, chunk_id, count(*) FILTER (chunk_id > 0) AS n_train, count(*) FILTER (chunk_id > 0 AND NOT artifact) AS n_clean, count(*) FILTER (chunk_id > 0 AND NOT artifact AND x > 20 AND x < 120) AS n_cond, count(*) FILTER (chunk_id > 0 AND NOT artifact AND x > 20) AS loud_n, count(*) FILTER (chunk_id > 0 AND NOT artifact AND x < 120) AS calm_n, count(*) FILTER (chunk_id > 0 AND x > 200) AS emg_n FROM s GROUP BY ALL)"


def _buckets(spark, sf):
    x = F.col("x")
    return advisor.buckets(signal(spark, sf), F.col("chunk_id") > 0, F.col("artifact"), {"loud": x > 20, "calm": x < 120}, {"emg": x > 200})


@query(f"WITH {SIG}, {_BUCKET} SELECT * FROM b")
def advisor_buckets(spark, sf):
    return _buckets(spark, sf)


_SUMS = ["n_train", "n_clean", "n_cond", "loud_n", "calm_n", "emg_n"]


_DECIDED = f"""{_BUCKET}, pairs AS (SELECT c.session_id, c.chunk_id, j.chunk_id AS back, {', '.join(f'sum(j.{n}) OVER (PARTITION BY c.session_id, c.chunk_id ORDER BY j.chunk_id DESC) AS {n}' for n in _SUMS)}, j.n_clean AS own FROM b c JOIN b j ON c.session_id = j.session_id AND j.chunk_id BETWEEN c.chunk_id - 5 AND c.chunk_id),
e AS (SELECT * FROM pairs WHERE n_clean - own < 12 QUALIFY row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY back) = 1),
d AS (SELECT b.session_id, b.chunk_id, b.n_train, e.n_clean::BIGINT AS n_clean_w, e.n_cond::BIGINT AS n_cond_w, e.loud_n / e.n_clean AS loud, e.calm_n / e.n_clean AS calm, CASE WHEN e.n_clean > 0 THEN e.n_cond / e.n_clean END AS rate, CASE WHEN e.n_train > 0 THEN e.emg_n / e.n_train ELSE 0.0 END AS guard FROM b JOIN e USING (session_id, chunk_id)),
a AS (SELECT *, CASE WHEN n_train = 0 THEN 'idle' WHEN guard > 0.15 THEN 'guarded' WHEN n_clean_w < 12 THEN 'collecting' WHEN rate < 0.5 THEN 'easier' WHEN rate > 0.75 THEN 'harder' ELSE 'hold' END AS advice FROM d)"""


@query(f"WITH {SIG}, {_DECIDED} SELECT session_id, chunk_id, n_clean_w, n_cond_w, round(rate, 6) AS pass_rate, round(guard, 6) AS guard_rate, advice FROM a")
def advisor_decisions(spark, sf):
    e = advisor.evidence(_buckets(spark, sf), 12, 6, _SUMS)
    return advisor.decide(e, 12, ["emg"]).withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("guard_rate", F.round("guard_rate", 6))


def _suggest(last: str, way: str) -> str:
    fire = f"(way <> 0 AND coalesce(w.chunk_id - {last} >= 2, true))"
    return f"w.session_id, w.chunk_id, advice, {fire} AS suggested, {fire} AND {way} = -w.way AS reversal, CASE WHEN {fire} THEN w.chunk_id ELSE {last} END AS last, CASE WHEN {fire} THEN w.way ELSE {way} END AS gone".replace("(way", "(w.way")


@query(f"""WITH RECURSIVE {SIG}, {_DECIDED}, w AS (SELECT session_id, chunk_id, advice, CASE advice WHEN 'harder' THEN 1 WHEN 'easier' THEN -1 ELSE 0 END AS way FROM a),
r AS (SELECT {_suggest('NULL::BIGINT', '0')} FROM w WHERE chunk_id = 0 UNION ALL SELECT {_suggest('r.last', 'r.gone').replace('advice,', 'w.advice,')} FROM r JOIN w ON w.session_id = r.session_id AND w.chunk_id = r.chunk_id + 1)
SELECT session_id, chunk_id, advice, suggested, reversal FROM r""")
def advisor_suggestions(spark, sf):
    e = advisor.evidence(_buckets(spark, sf), 12, 6, _SUMS)
    d = advisor.suggest(advisor.decide(e, 12, ["emg"]), 2)
    return d.select("session_id", "chunk_id", "advice", "suggested", "reversal")


_LEDGER = """x1 AS (SELECT r.* EXCLUDE (chunk_id), c.chunk_id, c.n_train, c.n_clean, c.n_cond, c.emg_n, c.act, coalesce(abs(c.manual - r.value) > 1e-12, false) AS changed, c.manual FROM r JOIN c ON c.session_id = r.session_id AND c.chunk_id = r.chunk_id + 1)"""

# A chunk's row after the host's word: x1 a value set by hand, x2 what was applied or dismissed, x3 evidence, x4 judgement, x5 what stands then.
_LEDGER_STEP = """SELECT session_id, chunk_id, value, now, settled, buckets, CASE WHEN fresh THEN cnt + 1 WHEN dest IS NULL THEN NULL ELSE sid END AS sid, CASE WHEN dest IS NOT NULL THEN reason END AS sreason, CASE WHEN dest IS NOT NULL THEN way END AS sway, dest AS sto,
 moved, uway, ubefore, uwrong, qe, qh, cnt + fresh::INT AS cnt, reason, array_to_string(list_filter([CASE WHEN changed THEN 'changed_manually' END, CASE WHEN applied THEN 'applied' END, CASE WHEN dismissed THEN 'dismissed' END, CASE WHEN equip THEN 'equipment_change' END,
 CASE WHEN t_sup OR (sid IS NOT NULL AND (fresh OR (dest IS NULL AND NOT early))) THEN 'superseded' END, CASE WHEN t_block OR (sid IS NOT NULL AND dest IS NULL AND early) THEN 'blocked' END, CASE WHEN fresh THEN 'suggested' END], lambda t: t IS NOT NULL), ',') AS told FROM (
SELECT *, reason IN ('not_training_phase', 'equipment_settling', 'guard') AS early, dest IS NOT NULL AND (sid IS NULL OR sreason <> reason OR sway <> way OR sto <> dest) AS fresh FROM (
SELECT * EXCLUDE (uway), CASE WHEN judged AND NOT back THEN NULL ELSE uway END AS uway, CASE WHEN back THEN true ELSE uwrong0 END AS uwrong,
 CASE WHEN n_train = 0 THEN 'not_training_phase' WHEN now < settled THEN 'equipment_settling' WHEN guarded THEN 'guard' WHEN cl < 12 THEN 'collecting' WHEN back THEN 'reversal' WHEN inside THEN 'on_track' WHEN step IS NULL THEN 'at_limit' WHEN now < wait THEN 'cooldown' WHEN side = 'easier' THEN 'too_strict' ELSE 'too_easy' END AS reason,
 CASE WHEN back THEN CASE uway WHEN 'harder' THEN 'easier' ELSE 'harder' END ELSE side END AS way, CASE WHEN NOT judged THEN NULL WHEN back THEN ubefore WHEN inside OR now < wait THEN NULL ELSE step END AS dest FROM (
SELECT *, judged AND uway IS NOT NULL AND NOT inside AND (uwrong0 OR CASE uway WHEN 'harder' THEN rate < 0.5 ELSE rate > 0.75 END) AS back, greatest(coalesce(moved + 16, -1), coalesce(CASE side WHEN 'easier' THEN qe ELSE qh END, -1)) AS wait,
 CASE WHEN side = 'harder' AND value < 40 THEN least(value + 2.5, 40) WHEN side = 'easier' AND value > 10 THEN greatest(value - 2.5, 10) END AS step FROM (
SELECT *, cl >= 12 AND n_train > 0 AND now >= settled AND NOT guarded AS judged, rate BETWEEN 0.5 AND 0.75 AS inside, CASE WHEN rate < 0.5 THEN 'easier' ELSE 'harder' END AS side FROM (
SELECT *, tr > 0 AND em / tr > 0.15 AS guarded, CASE WHEN cl > 0 THEN co / cl END AS rate FROM (
SELECT *, coalesce(list_sum(list_transform(used, lambda b: b.tr)), 0) AS tr, coalesce(list_sum(list_transform(used, lambda b: b.cl)), 0) AS cl, coalesce(list_sum(list_transform(used, lambda b: b.co)), 0) AS co, coalesce(list_sum(list_transform(used, lambda b: b.em)), 0) AS em FROM (
SELECT *, CASE WHEN len(buckets) > 1 AND buckets[-1].cl < 12 THEN CASE WHEN len(buckets) > 2 AND buckets[-1].cl + buckets[-2].cl < 12 THEN buckets[-3:] ELSE buckets[-2:] END ELSE buckets[-1:] END AS used FROM (
SELECT * EXCLUDE (now, buckets), now + 8 AS now, list_filter(CASE WHEN n_train > 0 AND now >= settled THEN list_append(buckets, {'e': now + 8, 'tr': n_train, 'cl': n_clean, 'co': n_cond, 'em': emg_n}) ELSE buckets END, lambda b: b.e > now - 16) AS buckets FROM (
SELECT session_id, chunk_id, n_train, n_clean, n_cond, emg_n, now, changed, applied, dismissed, t_sup, equip, equip AND sid IS NOT NULL AND NOT applied AND NOT dismissed AS t_block,
 CASE WHEN applied THEN sto ELSE value END AS value, CASE WHEN applied THEN now ELSE moved END AS moved, CASE WHEN equip THEN now + 8 ELSE settled END AS settled, CASE WHEN applied OR equip THEN [] ELSE buckets END AS buckets,
 CASE WHEN applied OR dismissed OR equip THEN NULL ELSE sid END AS sid, sreason, sway, sto, cnt, CASE WHEN dismissed AND sway = 'easier' THEN now + 16 ELSE qe END AS qe, CASE WHEN dismissed AND sway = 'harder' THEN now + 16 ELSE qh END AS qh,
 CASE WHEN (applied OR dismissed) AND sreason = 'reversal' THEN NULL WHEN applied THEN sway ELSE uway END AS uway, CASE WHEN applied THEN value ELSE ubefore END AS ubefore, CASE WHEN applied THEN false ELSE uwrong END AS uwrong0 FROM (
SELECT *, coalesce(act = 1, false) AND sid IS NOT NULL AS applied, coalesce(act = 2, false) AND sid IS NOT NULL AS dismissed, coalesce(act = 3, false) AS equip FROM (
SELECT * EXCLUDE (value, sid, uway, moved, buckets), changed AND sid IS NOT NULL AS t_sup, CASE WHEN changed THEN manual ELSE value END AS value, CASE WHEN NOT changed THEN sid END AS sid, CASE WHEN NOT changed THEN uway END AS uway, CASE WHEN changed THEN now ELSE moved END AS moved, CASE WHEN changed THEN [] ELSE buckets END AS buckets FROM x1)))))))))))"""


@query(f"""WITH RECURSIVE {SIG}, {_BUCKET}, c AS (SELECT *, session_id + chunk_id AS place, CASE WHEN (session_id + chunk_id) % 5 = 2 THEN 1 WHEN (session_id + chunk_id) % 7 = 3 THEN 2 WHEN (session_id + chunk_id) % 11 = 4 THEN 3 END AS act, CASE WHEN (session_id + chunk_id) % 13 = 6 THEN 25::DOUBLE END AS manual FROM b),
r AS (SELECT DISTINCT session_id, -1::BIGINT AS chunk_id, 20::DOUBLE AS value, 0::BIGINT AS now, 0::BIGINT AS settled, []::STRUCT(e BIGINT, tr BIGINT, cl BIGINT, co BIGINT, em BIGINT)[] AS buckets, NULL::BIGINT AS sid, NULL::VARCHAR AS sreason, NULL::VARCHAR AS sway, NULL::DOUBLE AS sto,
 NULL::BIGINT AS moved, NULL::VARCHAR AS uway, NULL::DOUBLE AS ubefore, false AS uwrong, NULL::BIGINT AS qe, NULL::BIGINT AS qh, 0::BIGINT AS cnt, '' AS reason, '' AS told FROM c
UNION ALL {_LEDGER_STEP.replace("FROM x1)", "FROM (" + _LEDGER[len("x1 AS (") : -1] + "))")})
SELECT session_id, chunk_id, reason, sid AS advice_id, value, sto AS proposed, told FROM r WHERE chunk_id >= 0""")
def advisor_ledger(spark, sf):
    """Advice that is kept: a host applies suggestions in some chunks, dismisses them in others, sets a value or changes equipment."""
    at = F.col("session_id") + F.col("chunk_id")
    counts = _buckets(spark, sf).withColumn("n", F.lit(float(CHUNK)))
    host_ = counts.select("session_id", "chunk_id", F.when(at % 5 == 2, 1.0).when(at % 7 == 3, 2.0).when(at % 11 == 4, 3.0).alias("act"), F.when(at % 13 == 6, 25.0).alias("manual"))
    out = advisor.ledger(counts, advisor.Knob(20.0, 2.5, 10.0, 40.0, watch=12, between=16, settle=8), ["emg"], host_)
    return out.withColumn("told", F.array_join("told", ","))


@query()
def advisor_knobs(spark, sf):
    """Two checks with a control each: one moves by steps, one is measured anew; a host applies and dismisses. Tests step it by hand, and against the ledger."""
    x, at = F.col("x"), F.col("session_id") + F.col("chunk_id")
    s = signal(spark, sf)
    host_ = s.select("session_id", "chunk_id").distinct().select("session_id", "chunk_id", F.when(at % 5 == 2, 1.0).when(at % 7 == 3, 2.0).when(at % 11 == 4, 3.0).alias("act"), F.when(at % 13 == 6, 25.0).alias("manual_floor"))
    policies = {"floor": adviser.Policy("loud", 20.0, 10.0, 40.0, step=2.5), "ceiling": adviser.Policy("calm", 120.0, 40.0, 200.0, "rebaseline", window=12, pct=90.0, harder_is_up=False)}
    rules = adviser.Rules(watch=12, between=16, settle=8)
    out = adviser.advise(s, F.col("chunk_id") > 0, F.col("artifact"), {"loud": x > 20, "calm": x < 120}, {"emg": x > 200}, policies, rules, {"ceiling": x}, host_)
    return out.withColumn("told", F.array_join("told", ",")).withColumn("proposed", r6(F.col("proposed")))


@query(f"""WITH RECURSIVE {SIG}, r AS (SELECT session_id, sample_idx, x AS peak, 2 * x AS twice FROM s WHERE sample_idx = 0
UNION ALL SELECT s.session_id, s.sample_idx, greatest(s.x, r.peak * 0.9), 2 * s.x FROM r JOIN s ON s.session_id = r.session_id AND s.sample_idx = r.sample_idx + 1)
SELECT session_id, sample_idx, round(twice, 6) + 0.0 AS twice, round(peak, 6) + 0.0 AS peak FROM r""")
def custom_steps(spark, sf):
    """A function and a kernel of a user's own, by name: doubling, and a peak that decays."""
    custom.function("query_twice")(lambda v: v * 2)
    custom.kernel("query_peak")(PeakHold)
    p = Protocol(FS, CHUNK).custom("query_twice", "twice", "x").custom("query_peak", "peak", "x", decay=0.9)
    return p.apply(signal(spark, sf)).select(*KEY, r6(F.col("twice")).alias("twice"), r6(F.col("peak")).alias("peak"))


@query(f"""WITH {SIG}, {_DECIDED}, m AS (SELECT *, CASE advice WHEN 'harder' THEN 1 WHEN 'easier' THEN -1 ELSE 0 END AS way FROM a)
SELECT session_id, chunk_id, advice, CASE way WHEN -1 THEN CASE WHEN calm <= loud THEN 'calm' ELSE 'loud' END WHEN 1 THEN CASE WHEN loud >= calm THEN 'loud' ELSE 'calm' END END AS limiter,
(20 + 2.5 * way)::DOUBLE AS stepped, CASE way WHEN 1 THEN 110 WHEN -1 THEN 130 ELSE 120 END::DOUBLE AS scaled FROM m""")
def advisor_proposals(spark, sf):
    """The check that limits, a fixed step of one control, a share of another one that gets harder as it falls."""
    e = advisor.evidence(_buckets(spark, sf), 12, 6, _SUMS)
    d = advisor.decide(e, 12, ["emg"], keep=("loud_n_w", "calm_n_w"))
    limit = advisor.limiter(F.col("advice"), {n: F.col(f"{n}_n_w") / F.nullif(F.col("n_clean_w"), F.lit(0)) for n in ("loud", "calm")})
    stepped = advisor.propose(F.lit(20.0), F.col("advice"), 2.5, 10.0, 40.0)
    scaled = advisor.propose_proportional(F.lit(120.0), F.col("advice"), 0.1, 10.0, 50.0, 200.0, harder_is_up=False)
    return d.select("session_id", "chunk_id", "advice", limit.alias("limiter"), stepped.alias("stepped"), scaled.alias("scaled"))


@query(f"""WITH {SIG}, f AS (SELECT session_id, sample_idx, unnest([x, x * 0.5, x + sample_idx % 3]) AS v FROM s) SELECT session_id::VARCHAR AS session_id, sample_idx, bool_and(v > 25) AS all_sites FROM f GROUP BY ALL""")
def site_fan_out(spark, sf):
    x = F.col("x")
    long = fan_out(signal(spark, sf), {"C3": x, "C4": x * 0.5, "Cz": x + F.col("sample_idx") % 3})
    both = combined(long, X.gt(F.col("x"), F.lit(25.0)))
    return both.select(F.col("session_id").cast("string").alias("session_id"), "sample_idx", F.col("condition").alias("all_sites"))


def _streamed(spark: SparkSession, sf: str, live: Callable[[DataFrame, DataFrame], DataFrame], commands: DataFrame | None = None, columns: str = "x double") -> DataFrame:
    """What ``live`` gives for samples and commands as streams: they are written as files, processed micro-batch by micro-batch, and the sink is read.

    Without ``commands``, the only ones are sessions' ends (with the number of their samples).
    """
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"{(shared or tempfile.mkdtemp(prefix='pulsegrid-')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    s = signal(spark, sf)
    s.select(*KEY, *[c.split()[0] for c in columns.split(",")]).repartition(4, "sample_idx").write.parquet(f"{at}/in")
    ends = s.groupBy("session_id").agg(F.max("chunk_id").alias("chunk_id"), F.lit("end").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    (ends if commands is None else commands.unionByName(ends)).repartition(3, "chunk_id").write.parquet(f"{at}/commands")
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/{name}")
    out = live(read(f"session_id long, sample_idx long, {columns}", "in"), read("session_id long, chunk_id long, name string, value double", "commands"))
    with state_store(spark):
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(_SMOOTH)
def streaming_smooth(spark, sf):
    """The smoothing kernel under Structured Streaming."""
    return _streamed(spark, sf, lambda s, _: stream_kernels(s, [K.Smooth("x", "y", 0.5, FS)])).select(*KEY, r6(F.col("y")).alias("y"))


def _gain(env, thr):
    ratio = np.divide(env, thr, out=np.zeros(len(env)), where=thr != 0)
    return 1.0 / (1.0 + np.exp(-4.0 * (ratio - 1.0)))


@query(ORACLE_SQL["reward_outputs"])
def streaming_outputs(spark, sf):
    """The protocol of reward_outputs live: one stateful pass from samples to output rows; a session's last, partial chunk runs when it ends."""
    steps = [
        K.Map(["x"], "env", np.abs), K.Percentile("env", "thr", 70.0, 32), K.Map(["x"], "loud", lambda x: x > 150.0, "boolean"), K.Gate("loud", "muted", 3),
        K.Map(["env", "thr"], "above", np.greater, "boolean"), K.Dwell("above", "reward", 2), K.Map(["env", "thr"], "gain", _gain),
    ]
    outs = [("analog", "audio_gain", "gain"), ("event", "audio_chime", "reward_event")]
    return _streamed(spark, sf, lambda s, ends: stream_outputs(s, steps, outs, CHUNK, FS, "muted", ends)).withColumn("value", r6(F.col("value")))


# The walk of host_commands; the seed is measured over the first phase, re-seeds (none here) and the host's values as in seeded_control.
@query(
    ORACLE_SQL["host_commands"].split("g AS (SELECT *, coalesce(sample_idx - max")[0]
    + f"""g AS (SELECT s.*, place, coalesce(sample_idx - max(CASE WHEN x > 90 THEN sample_idx END) OVER (PARTITION BY s.session_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) <= 3, false) AS muted, sample_idx = first AND coalesce(stopped, false) AS reset
 FROM s JOIN r USING (session_id, chunk_id) JOIN c USING (session_id, chunk_id)),
b AS (SELECT session_id, min(chunk_id) AS start FROM r WHERE place >= 1 GROUP BY ALL),
q AS (SELECT session_id, quantile_cont(x, 0.75) * 1.2 AS seed, count(*) = 6 AS whole FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sample_idx DESC) AS k FROM g WHERE place = 0 AND NOT artifact) WHERE k <= 6 GROUP BY ALL),
t AS (SELECT session_id, chunk_id, (50 + session_id % 9)::DOUBLE AS value FROM s WHERE (session_id + 3 * chunk_id) % 8 = 1 GROUP BY ALL),
o AS (SELECT t.session_id, bool_or(chunk_id <= start) AS early FROM t JOIN b USING (session_id) GROUP BY ALL),
j AS (SELECT g.*, g.chunk_id >= start AND NOT coalesce(early, false) AS run, seed, whole, t.value AS told FROM g ASOF LEFT JOIN t ON g.session_id = t.session_id AND g.chunk_id >= t.chunk_id
 LEFT JOIN b ON b.session_id = g.session_id LEFT JOIN o ON o.session_id = g.session_id LEFT JOIN q ON q.session_id = g.session_id WHERE place >= 0),
v AS (SELECT *, CASE WHEN told IS NOT NULL THEN told WHEN run AND whole THEN seed ELSE 70 END AS thr, muted OR place IN (0, 2) OR (run AND NOT coalesce(whole, false)) AS quiet FROM j),
w AS (SELECT *, x > thr AND NOT muted AND place NOT IN (0, 2) AS ok FROM v),
d AS (SELECT *, sample_idx - coalesce(max(CASE WHEN NOT ok THEN sample_idx WHEN reset THEN sample_idx - 1 END) OVER {W} ROWS UNBOUNDED PRECEDING), -1) AS k FROM w)
SELECT session_id, min(sample_idx) / 16.0::DOUBLE AS timestamp_s, 'audio_gain' AS channel, 'value' AS kind, round(avg(CASE WHEN quiet THEN 0 ELSE least(greatest(x / (thr + 37.3), 0), 1) END), 6) + 0.0 AS value FROM d GROUP BY session_id, chunk_id
UNION ALL SELECT session_id, sample_idx / 16.0::DOUBLE, 'audio_chime', 'event', NULL FROM d WHERE k = 2 AND ok AND NOT quiet"""
)
def live_session(spark, sf):
    """A protocol under a host, live: phases, commands, a seeded threshold that the host may set, a gate, a hold with resets, outputs; samples and commands come in any split."""
    s = signal(spark, sf)
    at = F.col("session_id"), F.col("chunk_id")
    hold, freeze = (at[0] + at[1]) % 5, (at[0] + 2 * at[1]) % 7
    rows = {"advance": F.when((at[0] + 3 * at[1]) % 11 == 4, 1.0), "hold": F.when(hold == 0, 1.0).when(hold == 1, 0.0), "freeze": F.when(freeze == 2, 1.0).when(freeze == 3, 0.0), "thr": F.when((at[0] + 3 * at[1]) % 8 == 1, 50.0 + at[0] % 9)}
    given = [F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in rows.items()]
    count = sum((F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in rows.values()), F.lit(0.0))
    told = s.select(*at).distinct().select(*at, F.inline(F.array(*given, F.struct(F.lit("tick").alias("name"), count.alias("value"))))).filter("value is not null")
    steps = [
        K.Map(["x"], "loud", lambda x: x > 90.0, "boolean"), K.Gate("loud", "muted", 3), K.Map(["artifact"], "clean", np.logical_not, "boolean"),
        K.Map(["x", "thr", "muted", "phase_muted"], "ok", lambda x, t, m, p: (x > t) & ~m & ~p, "boolean"), K.Dwell("ok", "h", 2, reset="hold_reset"), K.Map(["x", "thr"], "gain", lambda x, t: x / (t + 37.3)),
    ]
    live = Live(FS, CHUNK, steps, [("analog", "audio_gain", "gain"), ("event", "audio_chime", "h_event")], "muted", FLOORED, {"thr": 70.0}, [Measure("thr", "x", 75.0, 6, 1.2, fresh="clean")], ticks=True)
    out = _streamed(spark, sf, lambda rows_, commands: run_live(rows_, live, commands), told, "x double, artifact boolean")
    return out.withColumn("value", r6(F.col("value")))


def entry(spark: SparkSession) -> DataFrame:
    return reward_outputs(spark, "/root/testdata/sf0.001")


__all__ = ["ORACLE_SQL", "QUERIES", "by_session", "entry"]
