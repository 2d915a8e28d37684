"""Advice on difficulty from counts by chunk: buckets, evidence over the last clean time, a decision.

Counts are one partial aggregation; evidence is a difference of running sums over
chunks, from where enough clean time is in it.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.host import with_kernels
from ..operators.kernels import Columns, Kernel
from ..operators.samples import CHUNK, INDEX, SESSION

# The defaults of a policy.
LOW, HIGH, WATCH_S, BETWEEN_S, SETTLE_S, GUARD_MAX = 0.50, 0.75, 120.0, 180.0, 60.0, 0.15


def buckets(samples: DataFrame, training: Column, muted: Column, checks: dict[str, Column], guards: dict[str, Column], combine: str = "all") -> DataFrame:
    """Counts of each chunk: n_train, n_clean, n_cond, <check>_n, <guard>_n."""
    clean = training & ~muted
    passed = None
    for c in checks.values():
        passed = c if passed is None else (passed & c if combine == "all" else passed | c)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return samples.groupBy(SESSION, CHUNK).agg(
        count(training).alias("n_train"), count(clean).alias("n_clean"), count(clean & passed).alias("n_cond"),
        *[count(clean & c).alias(f"{n}_n") for n, c in checks.items()], *[count(training & g).alias(f"{n}_n") for n, g in guards.items()],
    )


class Evidence(Kernel):
    """Sums of each count over the fewest last chunks (at most ``horizon``) with ``watch`` clean samples, from running sums: a search finds where the watch is full."""

    def __init__(self, names: list[str], watch: int, horizon: int):
        self.inputs, self.outputs = names, {f"{n}_w": "double" for n in names}
        self.clean, self.watch, self.horizon = names.index("n_clean"), watch, horizon
        self.held = np.zeros((0, len(names)))

    def step(self, c: Columns) -> Columns:
        rows = np.concatenate([self.held, np.stack([c[n].astype(float) for n in self.inputs], 1)])
        old, sums = len(self.held), np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0)])
        at, clean = np.arange(old, len(rows)), sums[1:, self.clean]
        # chunk j is needed as long as those after it hold less than the watch
        first = np.maximum(np.searchsorted(clean, clean[at] - self.watch, "right"), at - self.horizon + 1)
        self.held = rows[max(0, len(rows) - self.horizon) :]
        return {f"{n}_w": sums[at + 1, i] - sums[first, i] for i, n in enumerate(self.inputs)}


def evidence(counts: DataFrame, watch: int, horizon: int, names: list[str]) -> DataFrame:
    """For each chunk the sums over the fewest last chunks (at most ``horizon``) with ``watch`` clean samples; sum columns <name>_w."""
    done = with_kernels(counts.withColumn(INDEX, F.col(CHUNK)), [Evidence(names, watch, horizon)])
    return done.select(SESSION, CHUNK, *names, *[F.col(f"{n}_w").cast("long").alias(f"{n}_w") for n in names])


def decide(evidence_: DataFrame, watch: int, guards: list[str], low: float = LOW, high: float = HIGH, guard_max: float = GUARD_MAX, settle_chunks: int = 0, has_reward: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """advice of each chunk: idle, settling, guarded, collecting, observing (the protocol has no reward condition), easier, hold or harder; and the columns of ``keep``."""
    rate = F.when(F.col("n_clean_w") > 0, F.col("n_cond_w") / F.col("n_clean_w"))
    guard = F.greatest(F.lit(0.0), *[F.when(F.col("n_train_w") > 0, F.col(f"{g}_n_w") / F.col("n_train_w")).otherwise(0.0) for g in guards]) if guards else F.lit(0.0)
    advice = (
        F.when(F.col("n_train") == 0, "idle").when(F.col(CHUNK) < settle_chunks, "settling").when(guard > guard_max, "guarded").when(F.col("n_clean_w") < watch, "collecting")
        .when(F.lit(not has_reward), "observing").when(rate < low, "easier").when(rate > high, "harder").otherwise("hold")
    )
    return evidence_.select(SESSION, CHUNK, "n_clean_w", "n_cond_w", rate.alias("pass_rate"), guard.alias("guard_rate"), advice.alias("advice"), *keep)


def limiter(advice: Column, rates: dict[str, Column], tighten_first: str | None = None) -> Column:
    """The check to change: the lowest pass rate to make it easier; the first to tighten, else the highest, to make it harder."""
    all_ = F.array(*[F.struct(r.alias("r"), F.lit(n).alias("n")) for n, r in rates.items()])
    harder = F.lit(tighten_first) if tighten_first else F.array_max(all_)["n"]
    return F.when(advice == "easier", F.array_min(all_)["n"]).when(advice == "harder", harder)


def propose(value: Column, advice: Column, step: float, low: float, high: float, harder_is_up: bool = True) -> Column:
    """One fixed step towards the advice, snapped to the step and kept within limits."""
    sign = F.when(advice == "harder", 1.0 if harder_is_up else -1.0).when(advice == "easier", -1.0 if harder_is_up else 1.0).otherwise(0.0)
    moved = F.round((value + sign * step) / step) * step
    return F.least(F.greatest(F.when(sign == 0, value).otherwise(moved), F.lit(low)), F.lit(high))


def propose_proportional(value: Column, advice: Column, share: float, round_to: float, low: float, high: float, harder_is_up: bool = True) -> Column:
    """A share of the value towards the advice, snapped and kept within limits."""
    up = 1.0 if harder_is_up else -1.0
    factor = F.when(advice == "harder", 1.0 + up * share).when(advice == "easier", 1.0 - up * share)
    moved = F.least(F.greatest(F.round(value * factor / round_to) * round_to, F.lit(low)), F.lit(high))
    return F.when(factor.isNull(), value).otherwise(moved)


class Suggestions(Kernel):
    """Which advice is given: one suggestion, then none for ``between`` chunks; one in the other direction right after the last is a reversal."""

    def __init__(self, direction: str, between: int):
        self.inputs, self.outputs = [direction], {"suggested": "boolean", "reversal": "boolean"}
        self.between, self.at, self.last, self.way = between, 0, None, 0.0

    def step(self, c: Columns) -> Columns:
        given, back = [], []
        for d in c[self.inputs[0]].tolist():
            fire = d != 0 and (self.last is None or self.at - self.last >= self.between)
            given.append(fire)
            back.append(fire and self.way == -d)
            if fire:
                self.last, self.way = self.at, d
            self.at += 1
        return {"suggested": np.array(given, bool), "reversal": np.array(back, bool)}


def suggest(decisions: DataFrame, between: int) -> DataFrame:
    """decide()'s rows with suggested and reversal."""
    d = decisions.withColumn("direction", F.when(F.col("advice") == "harder", 1.0).when(F.col("advice") == "easier", -1.0).otherwise(0.0))
    rows = d.withColumn(INDEX, F.col(CHUNK)).drop(CHUNK)
    return with_kernels(rows, [Suggestions("direction", between)]).withColumnRenamed(INDEX, CHUNK).drop("direction")


@dataclass(frozen=True)
class Knob:
    """A control that advice moves by a fixed step. Times are samples of training."""

    start: float
    step: float
    low: float
    high: float
    watch: int
    between: int
    settle: int
    round_to: float = 0.0
    harder_is_up: bool = True
    pass_low: float = LOW
    pass_high: float = HIGH
    guard_max: float = GUARD_MAX


# Why advice is as it is, and the kinds of a ledger's events.
REASONS = ("not_training_phase", "equipment_settling", "guard", "collecting", "on_track", "too_strict", "too_easy", "at_limit", "cooldown", "reversal")
EVENTS = ("changed_manually", "applied", "dismissed", "equipment_change", "superseded", "blocked", "suggested")


class Ledger(Kernel):
    """Advice with a memory, over rows of chunks (n, n_train, n_clean, n_cond, <guard>_n), and what a host does with it before a chunk.

    ``act``: 1 applies the standing suggestion, 2 dismisses it, 3 marks an equipment change; ``manual``: a value that the host sets (NaN: none).
    Evidence starts anew when the value moves or equipment changes. A value can move again after ``between``, a direction that was
    dismissed comes back after it; a change after which the pass rate lies beyond the other limit is advised back, at once.
    """

    def __init__(self, knob: Knob, guards: list[str]):
        self.inputs = ["n", "n_train", "n_clean", "n_cond", "act", "manual", *[f"{g}_n" for g in guards]]
        self.outputs = {"reason": "double", "advice_id": "double", "value": "double", "proposed": "double", **{e: "boolean" for e in EVENTS}}
        self.knob, self.value, self.now, self.settled, self.count = knob, knob.start, 0.0, 0.0, 0
        self.buckets: deque[tuple[float, ...]] = deque()
        self.standing: tuple[int, str, str, float] | None = None  # id, reason, direction, value
        self.moved: float | None = None
        self.undo: tuple[str, float, bool] | None = None  # direction of the last change, value before it, whether it proved wrong
        self.quiet: dict[str, float] = {}

    def _forget(self) -> None:
        self.buckets.clear()

    def _evidence(self) -> np.ndarray:
        """Sums over the fewest last chunks with enough clean samples, none of them older than two watches."""
        total = np.zeros(len(self.inputs) - 3)
        for end, *counts in reversed(self.buckets):
            if end <= self.now - 2 * self.knob.watch or total[1] >= self.knob.watch:
                break
            total += counts
        return total

    def _moved_by(self, direction: str) -> float | None:
        k, up = self.knob, (direction == "harder") == self.knob.harder_is_up
        v = self.value + (k.step if up else -k.step)
        v = min(max(round(v / k.round_to) * k.round_to if k.round_to else v, k.low), k.high)
        return v if abs(v - self.value) >= 1e-9 and (v > self.value) == up else None

    def _judge(self, training: bool) -> tuple[str, str, float | None]:
        """Reason, direction, proposed value (None: nothing to suggest)."""
        k = self.knob
        if not training:
            return "not_training_phase", "", None
        if self.now < self.settled:
            return "equipment_settling", "", None
        train, clean, passed, *guards = self._evidence()
        if train and max(guards, default=0.0) / train > k.guard_max:
            return "guard", "", None
        if clean < k.watch:
            return "collecting", "", None
        rate = passed / clean
        if self.undo is not None:
            went, before, wrong = self.undo
            wrong = wrong or (rate < k.pass_low if went == "harder" else rate > k.pass_high)
            inside = k.pass_low <= rate <= k.pass_high
            self.undo = (went, before, True) if wrong and not inside else None
            if self.undo is not None:
                return "reversal", "easier" if went == "harder" else "harder", before
        if k.pass_low <= rate <= k.pass_high:
            return "on_track", "", None
        way = "easier" if rate < k.pass_low else "harder"
        to = self._moved_by(way)
        if to is None:
            return "at_limit", way, None
        wait = max(-math.inf if self.moved is None else self.moved + k.between, self.quiet.get(way, -math.inf))
        return ("cooldown", way, None) if self.now < wait else ("too_strict" if way == "easier" else "too_easy", way, to)

    def _publish(self, training: bool, told: set[str]) -> str:
        reason, way, to = self._judge(training)
        if to is None:
            if self.standing is not None:
                told.add("blocked" if reason in REASONS[:3] else "superseded")
            self.standing = None
        elif self.standing is None or self.standing[1:] != (reason, way, to):
            if self.standing is not None:
                told.add("superseded")
            self.count += 1
            self.standing = (self.count, reason, way, to)
            told.add("suggested")
        return reason

    def _host(self, act: float, manual: float, told: set[str]) -> None:
        if not math.isnan(manual) and abs(manual - self.value) > 1e-12:
            told.add("changed_manually")
            if self.standing is not None:
                told.add("superseded")
            self.value, self.standing, self.undo, self.moved = manual, None, None, self.now
            self._forget()
        if act in (1.0, 2.0) and self.standing is not None:
            _, reason, way, to = self.standing
            if act == 1.0:
                told.add("applied")
                self.undo = None if reason == "reversal" else (way, self.value, False)
                self.value, self.moved = to, self.now
                self._forget()
            else:
                told.add("dismissed")
                self.quiet[way] = self.now + self.knob.between
                self.undo = None if reason == "reversal" else self.undo
            self.standing = None
        if act == 3.0:
            told.add("equipment_change")
            if self.standing is not None:
                told.add("blocked")
            self.standing, self.settled = None, self.now + self.knob.settle
            self._forget()

    def step(self, c: Columns) -> Columns:
        out: dict[str, list] = {o: [] for o in self.outputs}
        for n, train, clean, passed, act, manual, *guards in zip(*(c[i].astype(float).tolist() for i in self.inputs)):
            told: set[str] = set()
            self._host(act, manual, told)
            begin, self.now = self.now, self.now + n
            if train and begin >= self.settled:
                self.buckets.append((self.now, train, clean, passed, *guards))
            while self.buckets and self.buckets[0][0] <= self.now - 2 * self.knob.watch:
                self.buckets.popleft()
            out["reason"].append(REASONS.index(self._publish(train > 0, told)))
            out["advice_id"].append(self.standing[0] if self.standing else math.nan)
            out["proposed"].append(self.standing[3] if self.standing else math.nan)
            out["value"].append(self.value)
            for e in EVENTS:
                out[e].append(e in told)
        return {o: np.array(v, bool if self.outputs[o] == "boolean" else float) for o, v in out.items()}


def ledger(counts: DataFrame, knob: Knob, guards: list[str], host: DataFrame | None = None) -> DataFrame:
    """For each chunk (rows of buckets(), and n, its samples): reason, advice_id, value, proposed, and told, the kinds of its events.

    host: session_id, chunk_id, act, manual (see Ledger), one row a chunk at most; sessions stay whole in one task, a row a chunk.
    """
    nan = F.lit(float("nan"))
    rows = counts.withColumns({"act": nan, "manual": nan}) if host is None else counts.join(host.select(SESSION, CHUNK, "act", "manual"), [SESSION, CHUNK], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), nan) for c in ("act", "manual")}).withColumn(INDEX, F.col(CHUNK))
    done = with_kernels(rows, [Ledger(knob, guards)])
    told = F.array_compact(F.array(*[F.when(F.col(e), F.lit(e)) for e in EVENTS]))
    names = F.array(*[F.lit(r) for r in REASONS])
    return done.select(SESSION, CHUNK, F.element_at(names, F.col("reason").cast("int") + 1).alias("reason"), F.col("advice_id").cast("long").alias("advice_id"), "value", "proposed", told.alias("told"))
