"""Sessions that run live: samples and host commands in one stream, state by session, a row of output as soon as its chunk is whole.

A stateful processor (transformWithStateInPandas) keeps typed state: a clock value, a list of samples that wait, maps of
commands that wait, of controls, of the rings that seeds are measured on, and of the kernels' numbers. What comes is taken in
the order of sample and chunk numbers, so any split into micro-batches gives the same rows:

* samples that come twice are dropped, early ones wait; beyond ``max_waiting`` of them a gap is declared: its samples are
  skipped and held outputs start anew;
* commands (session_id, chunk_id, name, value) take effect before their chunk, or before the next one if they come late. With
  ``ticks``, a chunk runs only once its row named tick has come and as many commands for it as that row's value says;
* ``end`` (value: the session's samples; null: those that are there) runs the last, partial chunk and drops the state; so does
  a timer after ``idle_ms`` without rows. A mark stays for ``mark_ms``: a sample that comes for a stopped session fails the
  query (``on_stopped="fail"``) or is dropped.

Names of commands: advance, hold, freeze (session.Cursor), tick, end; any other sets a control.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import trackers
from ..operators.host import advance
from ..operators.kernels import Columns, Kernel
from ..operators.outputs import check_kind
from ..operators.samples import CHUNK, INDEX, SESSION
from ..plans.session import COMMANDS, Cursor, Phase


@dataclass(frozen=True)
class Measure:
    """A control measured on a stream: pct of its last n finite samples where ``fresh`` (a boolean column; None: all), times scale (then clamped).

    every None: a seed, measured over the first phase and written when it ends, unless the host has set the control; with fewer
    than n samples the session stays muted. Else a re-seed, written at every ``every``-th chunk that finds n fresh samples since
    the last write, until the host sets the control; it resets held outputs.
    """

    control: str
    x: str
    pct: float
    n: int
    scale: float = 1.0
    low: float | None = None
    high: float | None = None
    fresh: str | None = None
    every: int | None = None

    def value(self, ring: np.ndarray) -> float:
        """The percentile weighs its two neighbours as F.percentile and quantile_cont do: numpy's interpolation rounds otherwise, and a sample may equal a threshold."""
        s = sorted(ring.tolist())
        at = (len(s) - 1) * (self.pct / 100.0)
        lo, hi = math.floor(at), math.ceil(at)
        v = (s[lo] if s[lo] == s[hi] else (hi - at) * s[lo] + (at - lo) * s[hi]) * self.scale
        return min(max(v, self.low), self.high) if self.scale != 1.0 and self.low is not None and self.high is not None else v


@dataclass(frozen=True)
class Live:
    """A protocol for the processor. Kernels see the samples' columns, each control as a column, and phase_index, phase_muted, seed_muted, hold_reset.

    channels: (analog or event, channel, column); none: rows are the samples with the kernels' columns instead of outputs.
    """

    fs: float
    chunk: int
    kernels: list[Kernel]
    channels: list[tuple[str, str, str]] = field(default_factory=list)
    muted: str | None = None
    phases: list[Phase] = field(default_factory=lambda: [Phase("run", None)])
    controls: dict[str, float] = field(default_factory=dict)
    measures: list[Measure] = field(default_factory=list)
    ticks: bool = False
    max_waiting: int = 1 << 16
    idle_ms: int | None = None
    mark_ms: int = 24 * 3600 * 1000
    on_stopped: str = "fail"
    whole: bool = True  # False: rows run as they come, without waiting for whole chunks (no commands then)

    def schema(self, samples: T.StructType) -> T.StructType:
        kind = samples[SESSION].dataType
        if self.channels:
            for how, name, _ in self.channels:
                check_kind(how, name)
            return T.StructType([T.StructField(SESSION, kind), *T.StructType.fromDDL("timestamp_s double, channel string, kind string, value double")])
        made = {n: k for kernel in self.kernels for n, k in kernel.outputs.items()}
        return T.StructType([*samples.fields, *[T.StructField(n, T.BooleanType() if k == "boolean" else T.DoubleType()) for n, k in made.items() if n not in samples.fieldNames()]])


class StoppedSession(RuntimeError):
    """A sample came for a session that has ended."""


CLOCK = "at long, chunks long, started boolean, ended boolean, total long, timer long, dead boolean"


class Processor(StatefulProcessor):
    def __init__(self, live: Live, samples: T.StructType, timed: bool):
        self.live, self.samples, self.timed = live, samples, timed
        self.columns = [f.name for f in samples.fields if f.name not in (SESSION, INDEX)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stored = T.StructType([T.StructField("at", T.LongType()), *[f for f in self.samples.fields if f.name in self.columns]])
        self.clock = handle.getValueState("clock", CLOCK)
        self.waiting = handle.getListState("waiting", stored)
        self.commands = handle.getMapState("commands", "chunk long", "names array<string>, vals array<double>")
        self.controls = handle.getMapState("controls", "name string", "value double, source string")
        self.rings = handle.getMapState("rings", "measure string", "vals array<double>, fresh long")
        self.numbers = handle.getMapState("numbers", "attribute string", "kind string, vals array<double>")
        self.stopped = handle.getValueState("stopped", "chunks long", self.live.mark_ms if self.timed else None)

    # --- state to objects and back ---

    def _load(self) -> None:
        live = self.live
        self.kernels, self.cursor = [k.anew() for k in live.kernels], Cursor(list(live.phases))
        self.at, self.chunks, self.started, self.ended, self.total, self.timer, self.dead = self.clock.get() if self.clock.exists() else (0, 0, False, False, None, None, False)
        numbers = {k[0]: (v[0], list(v[1])) for k, v in self.numbers.iterator()}
        for i, k in enumerate([self.cursor, *self.kernels]):
            k.load({n.split(".", 1)[1]: v for n, v in numbers.items() if n.split(".", 1)[0] == str(i)})
        for i, k in enumerate(self.kernels) if not self.started else ():
            snapshot = {n.split(".", 2)[2]: v[1][0] for n, v in numbers.items() if n.startswith(f"{i}.start.")}
            if snapshot and not self.at:
                trackers.start(k, snapshot)
        self.set = {k[0]: (v[0], v[1]) for k, v in self.controls.iterator()} if live.controls else {}
        self.ring = {k[0]: (np.array(v[0], float), v[1]) for k, v in self.rings.iterator()} if live.measures else {}
        self.due = {k[0]: list(zip(v[0], v[1])) for k, v in self.commands.iterator()}

    def _save(self) -> None:
        self.clock.update((self.at, self.chunks, self.started, self.ended, self.total, self.timer, self.dead))
        for i, k in enumerate([self.cursor, *self.kernels]):
            for n, v in k.save().items():
                self.numbers.updateValue((f"{i}.{n}",), v)
        for n, v in self.set.items():
            self.controls.updateValue((n,), v)
        for n, (v, fresh) in self.ring.items():
            self.rings.updateValue((n,), (v.tolist(), fresh))
        for c in [k[0] for k in self.commands.keys()]:
            if c not in self.due:
                self.commands.removeKey((c,))
        for c, told in self.due.items():
            self.commands.updateValue((c,), ([n for n, _ in told], [v for _, v in told]))

    def _drop(self) -> None:
        for s in (self.clock, self.waiting, self.commands, self.controls, self.rings, self.numbers):
            s.clear()
        self.stopped.update((self.chunks,))
        if self.timer is not None:
            self.handle.deleteTimer(self.timer)

    # --- one chunk ---

    def _written(self, told: list[tuple[str, float]], run: bool, place: int) -> bool:
        """Host values, then seeds and re-seeds before a chunk; whether a re-seed wrote."""
        wrote = False
        for n, v in told:
            if n in self.live.controls:
                self.set[n] = (float(v), "host")
        for m in self.live.measures:
            ring, fresh = self.ring.get(f"{m.control}.{m.every}", (np.empty(0), 0))
            host = self.set.get(m.control, (0.0, ""))[1] == "host"
            if m.every is None:
                if run and not self.started and not host:
                    if len(ring) == m.n:
                        self.set[m.control] = (m.value(ring), "seed")
                    else:
                        self.dead = True
            elif not host and not self.dead and self.chunks and self.chunks % m.every == 0 and fresh >= m.n:
                self.set[m.control] = (m.value(ring), "reseed")
                self.ring[f"{m.control}.{m.every}"] = (ring, 0)
                wrote = True
        self.started |= run
        return wrote

    def _chunk(self, key: object, rows: pd.DataFrame, told: list[tuple[str, float]], gap: bool) -> pd.DataFrame | None:
        live, n = self.live, len(rows)
        given = {c: max((v for k, v in told if k == c), default=np.nan) for c in COMMANDS}
        place = int(self.cursor.step({"n": np.array([n]), **{c: np.array([v]) for c, v in given.items()}})["at"][0])
        wrote = self._written(told, place >= 1 or (place == 0 and len(live.phases) == 1), place)
        self.chunks += 1
        if place < 0:
            return None
        first = np.arange(n) == 0
        columns: Columns = {c: rows[c].to_numpy() for c in self.columns} | {INDEX: rows["at"].to_numpy()}
        columns |= {c: np.full(n, self.set[c][0] if c in self.set else v) for c, v in live.controls.items()}
        columns |= {"phase_index": np.full(n, float(place)), "phase_muted": np.full(n, live.phases[place].muted), "seed_muted": np.full(n, self.dead)}
        columns["hold_reset"] = first & (wrote or gap or given["freeze"] == 1.0)
        columns |= advance(self.kernels, columns, np.array([0, n]) if live.whole else None)
        for m in live.measures:
            if m.every is None and place:
                continue
            x = columns[m.x].astype(float)
            take = x[np.isfinite(x) & (columns[m.fresh].astype(bool) if m.fresh else True)]
            ring, fresh = self.ring.get(f"{m.control}.{m.every}", (np.empty(0), 0))
            self.ring[f"{m.control}.{m.every}"] = (np.concatenate([ring, take])[-m.n :], fresh + len(take))
        return self._emitted(key, columns)

    def _emitted(self, key: object, columns: Columns) -> pd.DataFrame:
        live, n = self.live, len(columns[INDEX])
        if not live.channels:
            made = [c for k in live.kernels for c in k.outputs if c not in self.columns]
            return pd.DataFrame({SESSION: [key] * n} | {c: columns[c] for c in [*[f.name for f in self.samples.fields if f.name != SESSION], *made]})
        quiet = columns["phase_muted"] | columns["seed_muted"] | (columns[live.muted].astype(bool) if live.muted else False)
        rows = []
        for how, name, column in live.channels:
            if how == "analog":
                rows.append((key, columns[INDEX][0] / live.fs, name, "value", np.where(quiet, 0.0, np.clip(columns[column].astype(float), 0.0, 1.0)).mean()))
            else:
                rows += [(key, i / live.fs, name, "event", None) for i in columns[INDEX][columns[column].astype(bool) & ~quiet]]
        return pd.DataFrame(rows, columns=[SESSION, "timestamp_s", "channel", "kind", "value"])

    # --- the stream ---

    def _ready(self, chunk: int) -> bool:
        if not self.live.ticks:
            return True
        told = self.due.get(chunk, [])
        tick = [v for n, v in told if n == "tick"]
        return bool(tick) and len(told) - len(tick) >= tick[0]

    def _run(self, key: object, rows: pd.DataFrame, force: bool = False) -> Iterator[pd.DataFrame]:
        """Whatever can run of the samples in hand; what can't waits."""
        live = self.live
        rows = rows[rows["at"] >= self.at].drop_duplicates("at").sort_values("at", ignore_index=True)
        gap = False
        while len(rows):
            at = rows["at"].to_numpy()
            if at[0] > self.at and (len(rows) > live.max_waiting or force):
                gap, self.at = True, int(at[0])
            whole = int((at == self.at + np.arange(len(at))).cumprod().sum())
            size = live.chunk - self.at % live.chunk if live.whole else whole
            last = whole < size and (force or (self.ended and self.total is not None and self.at + whole >= self.total) or (gap and whole < len(at) and len(rows) > live.max_waiting))
            n = min(size, whole)
            if not n or (whole < size and not last) or not (force or self._ready(self.chunks)):
                break
            told = [x for c in sorted(k for k in self.due if k <= self.chunks) for x in self.due.pop(c) if x[0] != "tick"]
            out = self._chunk(key, rows.iloc[:n], told, gap)
            self.at, gap, rows = self.at + n, False, rows.iloc[n:].reset_index(drop=True)
            if out is not None and len(out):
                yield out
        self.rows = rows

    def _hold(self) -> None:
        if len(self.rows):
            self.waiting.put([tuple(None if pd.isna(v) else v for v in r) for r in self.rows[["at", *self.columns]].astype(object).itertuples(index=False)])
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live, session = self.live, key[0]
        got = pd.concat(list(rows), ignore_index=True)
        got.columns = [SESSION, "at", "_name", "_value", *self.columns]  # by place: names may have been changed on the way
        told, samples = got[got["_name"].notna()], got[got["_name"].isna()][["at", *self.columns]]
        if self.stopped.exists():
            if len(samples) and live.on_stopped == "fail":
                raise StoppedSession(f"session {session} has stopped")
            return
        self._load()
        for at, name, value in told[["at", "_name", "_value"]].itertuples(index=False):
            if name == "end":
                self.ended, self.total = True, None if pd.isna(value) else int(value)
            else:
                self.due.setdefault(int(at), []).append((name, float(value) if not pd.isna(value) else 0.0))
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            kinds = {c: samples[c].dtype for c in self.columns}
            samples = pd.concat([pd.DataFrame(held, columns=["at", *self.columns]).astype({c: k for c, k in kinds.items() if k != object and not samples.empty}), samples], ignore_index=True)
        yield from self._run(session, samples)
        if self.ended and (self.total is None or self.at >= self.total):
            yield from self._run(session, self.rows, True)
            self._drop()
            return
        self._hold()
        if live.idle_ms:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.timer = timerValues.getCurrentProcessingTimeInMs() + live.idle_ms
            self.handle.registerTimer(self.timer)
        self._save()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A snapshot of another session (kernel, its place among the kernels, and fields as columns) for a tracker to start from."""
        for i, k in enumerate(self.live.kernels):
            for row in initialState[initialState["kernel"] == i].to_dict("records"):
                for f in trackers.fields(k):
                    self.numbers.updateValue((f"{i}.start.{f}",), ("float", [float(row[f])]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        self._load()
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], columns=["at", *self.columns])
        yield from self._run(key[0], held, True)
        self.timer = None
        self._drop()

    def close(self) -> None:
        pass


# Fixed value: the state store that has column families.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_live(samples: DataFrame, live: Live, commands: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """starts: a batch table of snapshots (session_id, kernel, and a tracker's fields) that new sessions' trackers begin with.

    Output rows (or streams) of live sessions. samples: session_id, sample_idx, columns; commands: session_id, chunk_id, name, value. Both streams. The state store has to be RocksDB: a session that names none gets it here; one that names another starts the query within state_store()."""
    schema = samples.drop(CHUNK).schema if CHUNK in samples.columns else samples.schema
    columns = [f for f in schema.fields if f.name not in (SESSION, INDEX)]
    conf = samples.sparkSession.conf
    if PROVIDER not in conf.getAll:  # Spark's default store can't hold this state
        conf.set(PROVIDER, ROCKS)
    if not live.whole and (live.channels or commands is not None or any(k.chunked for k in live.kernels)):
        raise ValueError("outputs, commands and kernels with chunks need whole chunks")
    rows = samples.select(SESSION, F.col(INDEX).cast("long").alias("_at"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("double").alias("_value"), *[f.name for f in columns])
    if commands is not None:
        rows = rows.unionByName(commands.select(SESSION, F.col(CHUNK).cast("long").alias("_at"), F.col("name").alias("_name"), F.col("value").cast("double").alias("_value")), allowMissingColumns=True)
    timed, initial = live.idle_ms is not None, None if starts is None else starts.groupBy(SESSION)
    return rows.groupBy(SESSION).transformWithStateInPandas(Processor(live, schema, timed), live.schema(schema), "append", "ProcessingTime" if timed else "None", initial)
