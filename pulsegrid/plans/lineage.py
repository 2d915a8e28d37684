"""What drives what in a protocol: a graph of named steps, each with what it reads, and walks over it.

A check's knob is the one control that sets its threshold: named by the threshold itself (directly, as an absolute value or as a
percentile's target), live, of a number's kind, and the only live control that the threshold reads, however indirectly.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from ..operators.kernels import Kernel

# Kinds of controls that advice may move; checks that a higher threshold makes harder or easier.
MOVABLE = ("number", "percent", "voltage", "frequency")
HARDER, EASIER = ("above", "at_or_above"), ("below",)


@dataclass(frozen=True)
class Control:
    kind: str = "number"
    live: bool = True


@dataclass(frozen=True)
class Threshold:
    """kind: absolute or percentile (others have no knob); knob: the control that is its value or its target."""

    kind: str
    knob: str | None
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    """op(signal, threshold); threshold: the name of a threshold or a control, or None for an expression, whose reads are ``others``."""

    op: str
    signal: str
    threshold: str | None
    others: tuple[str, ...] = ()


@dataclass
class Lineage:
    controls: dict[str, Control] = field(default_factory=dict)
    thresholds: dict[str, Threshold] = field(default_factory=dict)
    reads: dict[str, tuple[str, ...]] = field(default_factory=dict)
    checks: dict[str, dict[str, Check]] = field(default_factory=dict)  # by bundle; "" is the protocol's own reward
    combine: dict[str, str] = field(default_factory=dict)
    inhibits: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def control(self, name: str, kind: str = "number", live: bool = True) -> "Lineage":
        self.controls[name] = Control(kind, live)
        return self

    def stream(self, name: str, *reads: str) -> "Lineage":
        self.reads[name] = reads
        return self

    def kernel(self, kernel: Kernel) -> "Lineage":
        """A kernel says itself what it reads."""
        for out in kernel.outputs:
            self.reads[out] = tuple(kernel.inputs)
        return self

    def threshold(self, name: str, kind: str, knob: str | None = None, *reads: str) -> "Lineage":
        self.thresholds[name] = Threshold(kind, knob, reads)
        return self

    def check(self, name: str, op: str, signal: str, threshold: str | None, *others: str, bundle: str = "") -> "Lineage":
        self.checks.setdefault(bundle, {})[name] = Check(op, signal, threshold, others)
        return self

    def inhibit(self, name: str, *reads: str) -> "Lineage":
        self.inhibits[name] = reads
        return self

    def feeds(self, *names: str) -> set[str]:
        """Controls that can be reached from these streams, thresholds and controls. A name that reads itself by a circle is walked once."""
        seen, found, todo = set(), set(), deque(names)
        while todo:
            name = todo.popleft()
            if name in seen:
                continue
            seen.add(name)
            if name in self.controls:
                found.add(name)
            t = self.thresholds.get(name)
            todo += (*self.reads.get(name, ()), *((t.reads + ((t.knob,) if t.knob else ())) if t else ()))
        return found

    def trace(self, check: Check) -> tuple[str, str] | None:
        """The knob of a check, and whether a higher value makes it harder or easier; None if that isn't one control."""
        if check.op not in HARDER + EASIER or check.threshold is None:
            return None
        t = self.thresholds.get(check.threshold)
        knob = check.threshold if t is None else t.knob if t.kind in ("absolute", "percentile") else None
        control = self.controls.get(knob) if knob else None
        live = {c for c in self.feeds(check.threshold) if self.controls[c].live}
        if control is None or live != {knob} or control.kind not in MOVABLE:
            return None
        return knob, "harder" if check.op in HARDER else "easier"

    def report(self) -> dict:
        """Every bundle's checks with knob, direction and all controls that feed them; the controls of checks and of inhibits."""
        bundles, of_checks = {}, set()
        for bundle in sorted(self.checks):
            rows = []
            for name, c in self.checks[bundle].items():
                feeds, traced = self.feeds(c.signal, *([c.threshold] if c.threshold else []), *c.others), self.trace(c)
                of_checks |= feeds
                rows.append({"name": name, "knob": traced and traced[0], "higher_is": traced and traced[1], "controls": sorted(feeds)})
            bundles[bundle] = {"combine": self.combine.get(bundle, "all"), "checks": rows}
        return {"bundles": bundles, "check_controls": sorted(of_checks), "inhibit_controls": sorted(set().union(*(self.feeds(*r) for r in self.inhibits.values())))}
