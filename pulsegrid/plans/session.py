"""Session timelines, host commands and controls on chunk numbers; seeds as aggregates of the warm-up."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.host import with_kernels
from ..operators.kernels import Columns, Kernel
from ..operators.samples import CHUNK, INDEX, SESSION


@dataclass(frozen=True)
class Phase:
    """A phase (samples; None: open), whether outputs are muted, and what its block selects. floor: a hold can extend it; inhibits: those that gate (none named: all)."""

    name: str
    samples: int | None
    muted: bool = False
    bundle: str | None = None
    inhibits: tuple[str, ...] | None = None
    floor: bool = False


def phase_ranges(phases: list[Phase], chunk: int) -> list[tuple[int, Phase, int, int | None]]:
    """(number, phase, first chunk, end chunk): a phase ends with the chunk in which its time is up, and lasts one chunk at least."""
    out, at = [], 0
    for i, p in enumerate(phases):
        end = None if p.samples is None else at + max(1, math.ceil(p.samples / chunk))
        out.append((i, p, at, end))
        if end is None:
            break
        at = end
    return out


def with_phase(samples: DataFrame, phases: list[Phase], chunk: int) -> DataFrame:
    """phase_index, phase, phase_muted, bundle of each sample; samples after the last timed phase go (the session has stopped). The phases are a few literals, so no join is needed."""
    ranges = phase_ranges(phases, chunk)
    within = lambda a, b: (F.col(CHUNK) >= a) if b is None else (F.col(CHUNK) >= a) & (F.col(CHUNK) < b)
    return _in_phase(samples, [(i, p, within(a, b)) for i, p, a, b in ranges])


def _in_phase(samples: DataFrame, cases: list[tuple[int, Phase, Column]]) -> DataFrame:
    pick = F
    for i, p, here in cases:
        pick = pick.when(here, F.struct(F.lit(i).alias("phase_index"), F.lit(p.name).alias("phase"), F.lit(p.muted).alias("phase_muted"), F.lit(p.bundle).cast("string").alias("bundle")))
    out = samples.withColumn("_p", pick)
    return out.filter(F.col("_p").isNotNull()).select(*samples.columns, "_p.*")


def allows(phases: list[Phase], inhibit: str) -> Column:
    """Whether the phase of a sample (phase_index) lets an inhibit gate."""
    return F.col("phase_index").isin([i for i, p in enumerate(phases) if not p.inhibits or inhibit in p.inhibits])


class Cursor(Kernel):
    """The phase of each chunk under host commands, which take effect before the chunk: advance, hold (floor phases only), freeze (of the clock).

    Inputs are rows of chunks: samples in it, and a number for each command (1 on, 0 off, NaN none). A phase ends after the
    chunk in which its time is up; -1 once the last has ended.
    """

    memory = ("index", "elapsed", "held", "frozen")

    def __init__(self, phases: list[Phase]):
        self.inputs, self.outputs = ["n", "advance", "hold", "freeze"], {"at": "double"}
        self.phases, self.index, self.elapsed, self.held, self.frozen = phases, 0, 0, False, False

    def _next(self) -> None:
        self.index, self.elapsed, self.held = self.index + 1, 0, False

    def step(self, c: Columns) -> Columns:
        at = []
        for n, advance, hold, freeze in zip(*(c[k].astype(float).tolist() for k in self.inputs)):
            if advance == 1.0 and self.index < len(self.phases):
                self._next()
            phase = self.phases[self.index] if self.index < len(self.phases) else None
            if phase and phase.floor and not math.isnan(hold):
                self.held = hold == 1.0
            if not math.isnan(freeze):
                self.frozen = freeze == 1.0
            at.append(self.index if phase else -1)
            if phase and not self.frozen:
                self.elapsed += n
                if phase.samples is not None and not self.held and self.elapsed >= phase.samples:
                    self._next()
        return {"at": np.array(at, float)}


COMMANDS = ("advance", "hold", "freeze")


def with_commands(samples: DataFrame, phases: list[Phase], commands: DataFrame) -> DataFrame:
    """with_phase under a host's commands (session_id, chunk_id, name, value), and hold_reset: a clock was frozen before this sample's chunk, so held outputs start anew.

    The cursor runs over rows of chunks; only its changes go back to the samples, as controls do.
    """
    given = commands.groupBy(SESSION, CHUNK).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in COMMANDS])
    sizes = samples.groupBy(SESSION, CHUNK).agg(F.count(F.lit(1)).cast("double").alias("n"), F.min(INDEX).alias("first"))
    chunks = sizes.join(given, [SESSION, CHUNK], "left").withColumns({n: F.coalesce(n, F.lit(float("nan"))) for n in COMMANDS})
    walked = with_kernels(chunks.withColumn(INDEX, F.col(CHUNK)), [Cursor(phases)])
    before = F.lag("at").over(Window.partitionBy(SESSION).orderBy(CHUNK))
    moves = walked.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("at")) | (F.col("freeze") == 1.0))
    marks = F.array(F.struct(F.lit("_at").alias("name"), F.col("at").alias("value")), F.struct(F.lit("_reset").alias("name"), F.when(F.col("freeze") == 1.0, F.col("first").cast("double")).alias("value")))
    timeline = moves.select(SESSION, CHUNK, F.inline(marks)).filter(F.col("value").isNotNull())
    out = with_controls(samples, timeline, {"_at": -1.0, "_reset": -1.0}).withColumn("hold_reset", F.col(INDEX) == F.col("_reset"))
    return _in_phase(out, [(i, p, F.col("_at") == i) for i, p in enumerate(phases)]).drop("_at", "_reset")


def with_controls(samples: DataFrame, timeline: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Live parameters: the last value set at or before each chunk (timeline: session_id, chunk_id, name, value), else the default.

    An as-of join by union and a running last value, on the window that the other operators use.
    """
    changes = timeline.groupBy(SESSION, CHUNK).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in defaults])
    rows = changes.select(SESSION, CHUNK, F.lit(-1).cast("long").alias(INDEX), *[F.col(n).alias(f"_{n}") for n in defaults])
    all_ = samples.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(SESSION).orderBy(CHUNK, INDEX).rowsBetween(Window.unboundedPreceding, 0)
    out = all_.withColumns({n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(w), F.lit(float(v))) for n, v in defaults.items()})
    return out.filter(F.col(INDEX) >= 0).select(*samples.columns, *defaults)


def seeds(samples: DataFrame, x: Column, warmup: Column, pct: float, n: int, scale: float = 1.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row a session: the percentile of the last n finite warm-up samples times scale, its count, and whether it is whole (else outputs stay muted)."""
    rows = samples.filter(warmup & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(SESSION, INDEX, x.alias("_x"))
    back = Window.partitionBy(SESSION).orderBy(F.desc(INDEX))
    kept = rows.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= n)
    value = F.percentile("_x", F.lit(pct / 100.0)) * scale
    if scale != 1.0 and low is not None and high is not None:
        value = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return kept.groupBy(SESSION).agg(value.alias("seed"), F.count(F.lit(1)).alias("seed_samples")).withColumn("seeded", F.col("seed_samples") == n)


def with_seed(samples: DataFrame, seeds_: DataFrame, timeline: DataFrame, name: str, default: float, start: int) -> DataFrame:
    """Columns ``name`` and seed_muted: the control takes its seed at chunk ``start``, the first that runs.

    A session whose seed isn't whole stays muted from then on. A value that the host sets (``timeline``, as in with_controls)
    at ``start`` or before disarms the seed; one set later replaces it, and a failed seed's mute stays.
    """
    host = timeline.filter(F.col("name") == name)
    early = host.groupBy(SESSION).agg(F.bool_or(F.col(CHUNK) <= start).alias("_disarmed"))
    seed = seeds_.select(SESSION, F.when(F.col("seeded"), F.col("seed")).alias("_seed")).join(early, SESSION, "full")
    set_ = with_controls(samples, host, {name: float("nan")})
    rows = set_.join(seed, SESSION, "left").withColumn("_run", (F.col(CHUNK) >= start) & ~F.coalesce("_disarmed", F.lit(False)))
    value = F.when(~F.isnan(name), F.col(name)).when(F.col("_run") & F.col("_seed").isNotNull(), F.col("_seed")).otherwise(default)
    return rows.withColumn("seed_muted", F.col("_run") & F.col("_seed").isNull()).withColumn(name, value).drop("_run", "_seed", "_disarmed")


def reseeds(samples: DataFrame, x: Column, block: Column, fresh: Column, pct: float, n: int) -> DataFrame:
    """One row for each session and block: the percentile of the last n fresh samples of the block before it, null (keep the old value) if it had fewer.

    ``fresh`` leaves out rests and artifact-muted samples.
    """
    rows = samples.filter(fresh & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(SESSION, INDEX, x.alias("_x"), block.alias("block"))
    back = Window.partitionBy(SESSION, "block").orderBy(F.desc(INDEX))
    kept = rows.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= n)
    got = kept.groupBy(SESSION, "block").agg(F.percentile("_x", F.lit(pct / 100.0)).alias("v"), F.count(F.lit(1)).alias("c"))
    return got.select(SESSION, (F.col("block") + 1).alias("block"), F.when(F.col("c") == n, F.col("v")).alias("reseed"))


class Refill(Kernel):
    """Rows of blocks in order: whether ``n`` fresh samples have come since the last block that took a new value, before this one."""

    def __init__(self, count: str, out: str, n: int):
        self.inputs, self.outputs, self.n, self.fresh = [count], {out: "boolean"}, n, 0.0

    def step(self, c: Columns) -> Columns:
        full = []
        for k in c[self.inputs[0]].astype(float).tolist():
            full.append(self.fresh >= self.n)
            self.fresh = k + (0.0 if full[-1] else self.fresh)
        return {next(iter(self.outputs)): np.array(full, bool)}


def reseed_writes(samples: DataFrame, x: Column, block: Column, fresh: Column, pct: float, n: int, scale: float = 1.0, low: float | None = None, high: float | None = None, dead: Column | None = None) -> DataFrame:
    """The values that with_reseeds() writes: session_id, _b (block), _v (value), _c and _i (the block's first chunk and sample), _n (fresh samples since the write before)."""
    ok = F.coalesce(fresh, F.lit(False)) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = samples.select(SESSION, INDEX, CHUNK, block.cast("long").alias("_b"), ok.alias("_ok"), x.alias("_x"), F.coalesce(F.lit(False) if dead is None else dead, F.lit(False)).alias("_dead"))
    blocks = rows.groupBy(SESSION, "_b").agg(F.count_if("_ok").cast("double").alias("_n"), F.min(CHUNK).alias("_c"), F.min(INDEX).cast("double").alias("_i"), F.min_by("_dead", INDEX).alias("_d"))
    filled = with_kernels(blocks.withColumn(INDEX, F.col("_b")), [Refill("_n", "_w", n)]).drop(INDEX)
    later = Window.partitionBy(SESSION).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    asks = filled.withColumn("_to", F.min(F.when(F.col("_w"), F.col("_b"))).over(later)).filter("_to is not null").select(SESSION, "_b", "_to")
    back = Window.partitionBy(SESSION, "_to").orderBy(F.desc(INDEX))
    last = rows.filter("_ok").join(asks, [SESSION, "_b"]).withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= n)
    value = F.percentile("_x", F.lit(pct / 100.0)) * scale
    if scale != 1.0 and low is not None and high is not None:
        value = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    since = asks.join(filled.select(SESSION, "_b", F.col("_n").alias("_fresh")), [SESSION, "_b"]).groupBy(SESSION, F.col("_to").alias("_b")).agg(F.sum("_fresh").cast("long").alias("_n"))
    made = last.groupBy(SESSION, F.col("_to").alias("_b")).agg(value.alias("_v")).join(since, [SESSION, "_b"]).join(filled.filter(~F.col("_d")).select(SESSION, "_b", "_c", "_i"), [SESSION, "_b"])
    return made


def seed_report(samples: DataFrame, control: str, source: str, got: DataFrame, timeline: DataFrame, start: int, pct: float, n: int, scale: float, fs: float, writes: DataFrame | None = None) -> DataFrame:
    """What became of a control's seed, a row a session: status, value, at_time_s, what it was measured on, and its history in order.

    got: seeds(); timeline: the host's values; start: the chunk at which seeds are written; writes: reseed_writes(), if it is measured anew.
    status: pending (the session never came to ``start``), disarmed (the host had set it by then), failed (fewer than n samples), fired. A
    record of the history has at_time_s, old_value (the measurement that it replaced), new_value, status, trigger (warmup, block), fresh_samples;
    a disarmed control has none. A host's later value ends re-seeds.
    """
    begun = samples.groupBy(SESSION).agg(F.min(F.when(F.col(CHUNK) >= start, F.col(INDEX))).alias("_at"))
    host = timeline.filter(F.col("name") == control).groupBy(SESSION).agg(F.min(CHUNK).alias("_host"))
    base = begun.join(got, SESSION, "left").join(host, SESSION, "left")
    fired = F.col("_at").isNotNull() & (F.col("_host").isNull() | (F.col("_host") > start))
    status = F.when(F.col("_at").isNull(), "pending").when(~fired, "disarmed").when(F.coalesce("seeded", F.lit(False)), "fired").otherwise("failed")
    base = base.withColumns({"status": status, "_time": F.col("_at") / fs})
    seed = F.when(F.col("status") == "fired", F.col("seed"))
    kinds = "struct<at_time_s: double, old_value: double, new_value: double, status: string, trigger: string, fresh_samples: bigint>"
    record = lambda *v: F.struct(*v).cast(kinds)
    null = F.lit(None).cast("double")
    first = F.when(F.col("status").isin("fired", "failed"), F.array(record(F.col("_time"), null, seed, F.col("status"), F.lit("warmup"), F.coalesce("seed_samples", F.lit(0)))))
    out = base.withColumn("_first", F.coalesce(first, F.array().cast(f"array<{kinds}>")))
    if writes is not None:
        later = writes.groupBy(SESSION).agg(F.sort_array(F.collect_list(F.struct((F.col("_i") / fs).alias("t"), F.col("_v").alias("v"), F.col("_n").alias("n"), F.col("_c").alias("c")))).alias("_w"))
        out = out.join(later, SESSION, "left")
        mine = F.filter(F.coalesce("_w", F.array().cast("array<struct<t: double, v: double, n: bigint, c: bigint>>")), lambda w: (F.col("status") == "fired") & (w["c"] > start) & (F.col("_host").isNull() | (w["c"] < F.col("_host"))))
        out = out.withColumn("_w", mine)
        old = lambda i: F.when(i == 0, seed).otherwise(F.get(F.col("_w"), i - 1)["v"])
        rows = F.transform("_w", lambda w, i: record(w["t"], old(i), w["v"], F.lit("fired"), F.lit("block"), w["n"]))
        out = out.withColumn("_first", F.concat("_first", rows))
    history = F.col("_first")
    value = F.when(F.size(history) > 0, F.element_at(history, -1)["new_value"])
    at = F.when(F.size(history) > 0, F.element_at(history, -1)["at_time_s"])
    facts = {"source": F.lit(source), "target_pct": F.lit(float(pct)), "scale": F.lit(float(scale)), "window_s": F.lit(n / fs)}
    return out.select(SESSION, F.lit(control).alias("control"), "status", value.alias("value"), at.alias("at_time_s"), F.coalesce("seed_samples", F.lit(0)).cast("long").alias("n_samples"), *[v.alias(k) for k, v in facts.items()], history.alias("history"))


def with_reseeds(samples: DataFrame, timeline: DataFrame, name: str, x: Column, block: Column, fresh: Column, pct: float, n: int, scale: float = 1.0, low: float | None = None, high: float | None = None, dead: Column | None = None) -> DataFrame:
    """The control ``name`` (a column, from with_controls or with_seed) measured anew where a block starts, and hold_reset at the samples where that wrote a value.

    The value is the percentile of the last n fresh finite samples times scale (then clamped). A block that finds fewer than n since
    the last write keeps the old value, and what is there counts for the next. Blocks are numbers that grow by chunks. A host's write
    (``timeline``, as in with_controls) ends it for the session, at its own chunk already; so does ``dead`` (a failed seed) at a
    block's first sample. A fresh sample belongs to one write at most, so all windows are one partitioning, not a range join.
    """
    made = reseed_writes(samples, x, block, fresh, pct, n, scale, low, high, dead)
    marks = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("_v", "_i")])
    set_ = with_controls(samples, made.select(SESSION, F.col("_c").alias(CHUNK), F.inline(marks)), {"_v": float("nan"), "_i": -1.0})
    host = timeline.filter(F.col("name") == name).groupBy(SESSION).agg(F.min(CHUNK).alias("_host"))
    out = set_.join(host, SESSION, "left")
    # written before the host took over: the host's chunk is later than the block's first one
    mine = ~F.isnan("_v") & (F.col("_host").isNull() | (F.col(CHUNK) < F.col("_host")))
    return out.withColumn("hold_reset", mine & (F.col(INDEX) == F.col("_i"))).withColumn(name, F.when(mine, F.col("_v")).otherwise(F.col(name))).drop("_v", "_i", "_host")
