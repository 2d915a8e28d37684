"""Advice over several controls: the check that limits the reward is traced to its control, which moves by its own policy.

A row a chunk, as advisor.ledger; the differences: one value, one manual column and one policy a control; a policy may measure
its control anew (``rebaseline``: a percentile of the last clean training samples of a signal, which the rows of chunks carry as
arrays of a chunk's size at most).
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.host import with_kernels
from ..operators.kernels import Columns, Kernel, interpolated
from ..operators.samples import CHUNK, INDEX, SESSION
from . import advisor
from .advisor import EVENTS, GUARD_MAX, HIGH, LOW

# Why advice is as it is.
REASONS = (*advisor.REASONS, "no_knob")


@dataclass(frozen=True)
class Policy:
    """How a control that fixes ``check`` moves. fixed: by step; proportional: by a share; rebaseline: to pct of the last ``window`` values."""

    check: str
    start: float
    low: float
    high: float
    strategy: str = "fixed"
    step: float = 0.0
    round_to: float = 0.0
    harder_is_up: bool = True
    window: int = 0
    pct: float = 50.0


@dataclass(frozen=True)
class Rules:
    """Times are samples. tighten_first: checks to make harder before others, if their control can move."""

    watch: int
    between: int
    settle: int
    pass_low: float = LOW
    pass_high: float = HIGH
    guard_max: float = GUARD_MAX
    tighten_first: tuple[str, ...] = ()


class Adviser(Kernel):
    def __init__(self, policies: dict[str, Policy], checks: list[str], guards: list[str], rules: Rules):
        self.policies, self.checks, self.guards, self.rules = policies, checks, guards, rules
        self.counts = ["n_train", "n_clean", "n_cond", *[f"{c}_n" for c in [*checks, *guards]]]
        self.measured = [c for c, p in policies.items() if p.strategy == "rebaseline"]
        self.inputs = ["n", "act", *self.counts, *[f"manual_{c}" for c in policies], *[f"values_{c}" for c in self.measured]]
        self.outputs = {k: "double" for k in ("reason", "advice_id", "limiter", "control", "proposed", *[f"value_{c}" for c in policies])} | {e: "boolean" for e in EVENTS}
        self.of_check = {p.check: c for c, p in policies.items()}
        self.value = {c: p.start for c, p in policies.items()}
        self.recent: dict[str, deque[float]] = {c: deque(maxlen=policies[c].window) for c in self.measured}
        self.now = self.settled = 0.0
        self.buckets: deque[tuple[float, np.ndarray]] = deque()
        self.moved: float | None = None
        self.undo: tuple[str, str, float, bool] | None = None
        self.quiet: dict[tuple[str, str], float] = {}
        self.standing: tuple | None = None
        self.count = 0

    def anew(self) -> "Adviser":
        return type(self)(self.policies, self.checks, self.guards, self.rules)

    def _forget(self) -> None:
        self.buckets.clear()
        for held in self.recent.values():
            held.clear()

    def _to(self, control: str, way: str) -> float | None:
        """Where the control would go; None if that isn't a move in this direction."""
        p, now = self.policies[control], self.value[control]
        up = (way == "harder") == p.harder_is_up
        if p.strategy == "rebaseline":
            held = self.recent[control]
            if len(held) < p.window:
                return None
            v = interpolated(sorted(held), p.pct)
        else:
            v = now * (1.0 + (p.step if up else -p.step)) if p.strategy == "proportional" else now + (p.step if up else -p.step)
        v = math.floor(v / p.round_to + 0.5) * p.round_to if p.round_to else v
        v = round(min(max(v, p.low), p.high), 6)
        return v if abs(v - now) >= 1e-9 and (v > now) == up else None

    def _limiter(self, rates: np.ndarray, way: str) -> int:
        """The check with the lowest rate to make reward easier; else the first to tighten that can move, or the highest."""
        if way == "easier":
            return int(rates.argmin())
        for name in self.rules.tighten_first:
            if name in self.checks and name in self.of_check and self._to(self.of_check[name], way) is not None:
                return self.checks.index(name)
        return int(rates.argmax())

    def _judge(self, training: bool) -> tuple[str, int | None, tuple[str, str, float] | None]:
        """Reason, limiting check, (control, direction, value) to suggest."""
        r = self.rules
        if not training:
            return "not_training_phase", None, None
        if self.now < self.settled:
            return "equipment_settling", None, None
        total = np.zeros(len(self.counts))
        for end, row in reversed(self.buckets):
            if end <= self.now - 2 * r.watch or total[1] >= r.watch:
                break
            total = total + row
        k = len(self.checks)
        if total[0] and max(total[3 + k :], default=0.0) / total[0] > r.guard_max:
            return "guard", None, None
        if total[1] < r.watch:
            return "collecting", None, None
        rate, rates = total[2] / total[1], total[3 : 3 + k] / total[1]
        inside = r.pass_low <= rate <= r.pass_high
        if self.undo is not None:
            control, went, before, wrong = self.undo
            wrong = wrong or (rate < r.pass_low if went == "harder" else rate > r.pass_high)
            self.undo = (control, went, before, True) if wrong and not inside else None
            if self.undo is not None:
                return "reversal", None, (control, "easier" if went == "harder" else "harder", before)
        if inside:
            return "on_track", None, None
        way = "easier" if rate < r.pass_low else "harder"
        i = self._limiter(rates, way)
        control = self.of_check.get(self.checks[i])
        if control is None:
            return "no_knob", i, None
        to = self._to(control, way)
        if to is None:
            return "at_limit", i, None
        wait = max(-math.inf if self.moved is None else self.moved + r.between, self.quiet.get((control, way), -math.inf))
        return ("cooldown", i, None) if self.now < wait else ("too_strict" if way == "easier" else "too_easy", i, (control, way, to))

    def _host(self, act: float, manual: dict[str, float], told: set[str]) -> None:
        for control, v in manual.items():
            if not math.isnan(v) and abs(v - self.value[control]) > 1e-12:
                told.add("changed_manually")
                if self.standing is not None:
                    told.add("superseded")
                self.value[control], self.standing, self.undo, self.moved = v, None, None, self.now
                self._forget()
        if act in (1.0, 2.0) and self.standing is not None:
            _, reason, control, way, to = self.standing
            if act == 1.0:
                told.add("applied")
                self.undo = None if reason == "reversal" else (control, way, self.value[control], False)
                self.value[control], self.moved = to, self.now
                self._forget()
            else:
                told.add("dismissed")
                self.quiet[control, way] = self.now + self.rules.between
                self.undo = None if reason == "reversal" else self.undo
            self.standing = None
        if act == 3.0:
            told.add("equipment_change")
            if self.standing is not None:
                told.add("blocked")
            self.standing, self.settled = None, self.now + self.rules.settle
            self._forget()

    def step(self, c: Columns) -> Columns:
        out: dict[str, list] = {o: [] for o in self.outputs}
        rows = np.stack([c[k].astype(float) for k in self.counts], 1)
        for i, (n, act) in enumerate(zip(c["n"].astype(float), c["act"].astype(float))):
            told: set[str] = set()
            self._host(act, {k: float(c[f"manual_{k}"][i]) for k in self.policies}, told)
            begin, self.now = self.now, self.now + n
            training = rows[i, 0] > 0
            if training and begin >= self.settled:
                self.buckets.append((self.now, rows[i]))
                for k in self.measured:
                    self.recent[k].extend(v for v in c[f"values_{k}"][i] if math.isfinite(v))
            while self.buckets and self.buckets[0][0] <= self.now - 2 * self.rules.watch:
                self.buckets.popleft()
            reason, limiter, move = self._judge(training)
            if move is None:
                if self.standing is not None:
                    told.add("blocked" if reason in REASONS[:3] else "superseded")
                self.standing = None
            elif self.standing is None or self.standing[1:] != (reason, *move):
                if self.standing is not None:
                    told.add("superseded")
                self.count += 1
                self.standing = (self.count, reason, *move)
                told.add("suggested")
            names = list(self.policies)
            out["reason"].append(REASONS.index(reason))
            out["limiter"].append(math.nan if limiter is None else limiter)
            out["advice_id"].append(self.standing[0] if self.standing else math.nan)
            out["control"].append(names.index(self.standing[2]) if self.standing else math.nan)
            out["proposed"].append(self.standing[4] if self.standing else math.nan)
            for k, v in self.value.items():
                out[f"value_{k}"].append(v)
            for e in EVENTS:
                out[e].append(e in told)
        return {o: np.array(v, bool if self.outputs[o] == "boolean" else float) for o, v in out.items()}


def advise(samples: DataFrame, training: Column, muted: Column, checks: dict[str, Column], guards: dict[str, Column], policies: dict[str, Policy], rules: Rules, sources: dict[str, Column] | None = None, host: DataFrame | None = None) -> DataFrame:
    """For each chunk: reason, limiter (check), advice_id, control, proposed, value_<control>, told.

    sources: the signal that a re-baselined control is measured on. host: session_id, chunk_id, act (advisor.Ledger) and
    manual_<control> columns, one row a chunk at most.
    """
    counts = advisor.buckets(samples, training, muted, checks, guards).join(samples.groupBy(SESSION, CHUNK).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.transform(F.array_sort(F.collect_list(F.when(training & ~muted & x.isNotNull(), F.struct(F.col(INDEX).alias("i"), x.cast("double").alias("v"))))), lambda s: s["v"]).alias(f"values_{k}") for k, x in (sources or {}).items()],
    ), [SESSION, CHUNK])
    wanted = ["act", *[f"manual_{c}" for c in policies]]
    nan = F.lit(float("nan"))
    if host is not None:
        counts = counts.join(host.select(SESSION, CHUNK, *[c for c in wanted if c in host.columns]), [SESSION, CHUNK], "left")
    rows = counts.withColumns({c: F.coalesce(F.col(c).cast("double"), nan) if c in counts.columns else nan for c in wanted})
    done = with_kernels(rows.withColumn(INDEX, F.col(CHUNK)), [Adviser(policies, list(checks), list(guards), rules)])
    named = lambda column, names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(column).cast("int") + 1)
    told = F.array_compact(F.array(*[F.when(F.col(e), F.lit(e)) for e in EVENTS]))
    return done.select(SESSION, CHUNK, named("reason", REASONS).alias("reason"), named("limiter", list(checks)).alias("limiter"), F.col("advice_id").cast("long").alias("advice_id"), named("control", list(policies)).alias("control"), "proposed", *[f"value_{c}" for c in policies], told.alias("told"))
