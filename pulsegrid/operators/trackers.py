"""Trackers whose state goes from one session to the next: exports as a table of snapshots, starts from it, chains of a client's visits.

A snapshot has one row a session: a percentile gives value, target_pct and n_eff, an auto range low, high and n_eff
(kernels.Percentile.export, kernels.AutoRange.export). A start refills the window: with the value n_eff times, or with a ramp
from low to high. Live sessions start from the same table (streaming.live.run_live, ``starts``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host import with_kernels
from .kernels import AutoRange, Columns, Kernel, Percentile
from .samples import INDEX, SESSION

Tracker = Percentile | AutoRange


def fields(tracker: Tracker) -> tuple[str, ...]:
    return ("value", "target_pct", "n_eff") if isinstance(tracker, Percentile) else ("low", "high", "n_eff")


def start(tracker: Tracker, snapshot: dict[str, float]) -> None:
    """Refill from another session's export; an empty one leaves the tracker as it is."""
    n = int(snapshot["n_eff"])
    if n > 0:
        tracker.seed(snapshot["value"], n) if isinstance(tracker, Percentile) else tracker.seed(snapshot["low"], snapshot["high"], n)


class Exporting(Kernel):
    """A tracker; on the last sample of what comes together also what it exports then, as <out>_<field> (elsewhere null)."""

    memory = ("tracker",)

    def __init__(self, tracker: Tracker):
        self.tracker, self.out = tracker, next(iter(tracker.outputs))
        self.inputs, self.outputs = tracker.inputs, tracker.outputs | {f"{self.out}_{f}": "double" for f in fields(tracker)}

    def step(self, c: Columns) -> Columns:
        done = self.tracker.step(c)
        for f, v in self.tracker.export().items():
            done[f"{self.out}_{f}"] = np.full(len(done[self.out]), np.nan)
            done[f"{self.out}_{f}"][-1:] = v
        return done


class Visits(Kernel):
    """A tracker over the visits of one client: each starts from what the one before exported. ``visit`` names a number that changes with visits; <out>_start: what a visit started from (null: nothing)."""

    memory = ("tracker", "at", "begun")

    def __init__(self, tracker: Tracker, visit: str):
        self.tracker, self.empty, self.out = tracker, tracker.anew(), next(iter(tracker.outputs))
        self.inputs, self.outputs = [*tracker.inputs, visit], tracker.outputs | {f"{self.out}_start": "double"}
        self.visit, self.at, self.begun = visit, np.nan, np.nan

    def step(self, c: Columns) -> Columns:
        v = c[self.visit].astype(float)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        parts, begun = [np.empty(0)], np.empty(len(v))
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if v[a] != self.at:
                if not np.isnan(self.at):
                    snapshot, self.tracker = self.tracker.export(), self.empty.anew()
                    start(self.tracker, snapshot)
                    self.begun = next(iter(snapshot.values())) if snapshot["n_eff"] else np.nan
                self.at = v[a]
            begun[a:b] = self.begun
            parts.append(self.tracker.step({k: c[k][a:b] for k in self.tracker.inputs})[self.out])
        return {self.out: np.concatenate(parts), f"{self.out}_start": begun}


def snapshots(samples: DataFrame, tracker: Tracker) -> DataFrame:
    """session_id and the tracker's export at the session's end: one row a session."""
    out, names = next(iter(tracker.outputs)), fields(tracker)
    done = with_kernels(samples, [Exporting(tracker)]).filter(F.col(f"{out}_n_eff").isNotNull())
    last = F.max_by(F.struct(*[F.col(f"{out}_{f}").alias(f) for f in names]), INDEX)
    return done.groupBy(SESSION).agg(last.alias("_s")).select(SESSION, *[F.col(f"_s.{f}").alias(f) for f in names])


def with_start(samples: DataFrame, starts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The samples with a snapshot's columns for their session (null: none), for trackers with ``start``."""
    return samples.join(starts.select(SESSION, *names), SESSION, "left")
