"""What a protocol says beside its computation: the amplifier it runs on, feedback that a host plays, impedance, markers, free fields.

It is one record, checked when it is made and carried to the output as metadata of the channel column, so a host that reads the
rows finds it; nothing here changes a number.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.outputs import check_kind
from .requirements import RequirementError

# References that a montage knows beside channels; kinds of feedback, and the times (ms) each may have.
REFERENCES = ("linked_ears", "common_average", "device")
TIMES = {"layer": ("attack", "release"), "event": ("rearm", "min_interval")}
AMP_REFERENCE = "amp.reference"


@dataclass(frozen=True)
class Amplifier:
    """reference: what its channels are measured against in hardware."""

    name: str
    channels: tuple[str, ...] = ()
    rates: tuple[float, ...] = ()
    reference: str | None = None
    couplings: tuple[str, ...] | None = None
    impedance: bool = False
    markers: tuple[str, ...] = ()


def reference(wanted: str, amp: Amplifier | None) -> str:
    """A montage's reference; amp.reference stands for the amplifier's and fails where that isn't known."""
    if wanted != AMP_REFERENCE:
        return wanted
    if amp is None or amp.reference is None:
        raise RequirementError("amp.reference needs an amplifier that names its reference")
    if amp.reference not in REFERENCES and amp.reference not in amp.channels:
        raise RequirementError(f"{amp.name} has the unknown reference {amp.reference}")
    return amp.reference


@dataclass(frozen=True)
class Feedback:
    """An entry that a host plays for an output: a layer follows an analog channel, an event an event channel."""

    name: str
    kind: str
    output: str
    role: str
    label: str
    priority: int = 0
    asset_role: str | None = None
    times: tuple[tuple[str, int], ...] = ()
    preview: bool = False
    suppress_on_inhibit: bool = True
    suppress_on_mute: bool = True
    reset_on_gap: bool = True

    def check(self, outputs: dict[str, str]) -> None:
        if self.kind not in TIMES:
            raise RequirementError(f"feedback {self.name}: no kind {self.kind}")
        want = "analog" if self.kind == "layer" else "event"
        if outputs.get(self.output) != want:
            raise RequirementError(f"feedback {self.name}: {self.output} isn't an {want} output")
        check_kind(want, self.output)
        for k, v in self.times:
            if k not in TIMES[self.kind] or v < 0:
                raise RequirementError(f"feedback {self.name}: a {self.kind} has no {k} of {v} ms")


@dataclass(frozen=True)
class Declaration:
    """impedance: the highest allowed, in kOhm; markers: names the recording has to give; meta: free fields for reports."""

    amp: Amplifier | None = None
    feedback: tuple[Feedback, ...] = ()
    impedance: float | None = None
    markers: tuple[str, ...] = ()
    meta: dict[str, str] = field(default_factory=dict)

    def check(self, outputs: dict[str, str]) -> "Declaration":
        """outputs: channel to kind (analog, event)."""
        names = [f.name for f in self.feedback]
        if len(set(names)) < len(names):
            raise RequirementError("feedback entries need distinct names")
        for f in self.feedback:
            f.check(outputs)
        if self.amp is not None:
            if self.impedance is not None and not self.amp.impedance:
                raise RequirementError(f"{self.amp.name} doesn't measure impedance")
            missing = [m for m in self.markers if m not in self.amp.markers]
            if missing:
                raise RequirementError(f"{self.amp.name} gives no markers {', '.join(missing)}")
        if self.impedance is not None and self.impedance <= 0:
            raise RequirementError("an impedance limit is above 0")
        return self

    def amended(self, *entries: Feedback) -> "Declaration":
        """With entries of the same names replaced, the others kept in their places, new ones at the end."""
        new = {f.name: f for f in entries}
        kept = tuple(new.pop(f.name, f) for f in self.feedback)
        return Declaration(self.amp, kept + tuple(new.values()), self.impedance, self.markers, self.meta)


def declared(rows: DataFrame, declaration: Declaration, outputs: dict[str, str]) -> DataFrame:
    """Output rows whose channel column carries the declaration as JSON under ``protocol``."""
    text = json.dumps(asdict(declaration.check(outputs)), sort_keys=True)
    return rows.withColumns({c: F.col(c).alias(c, metadata={"protocol": text}) for c in ("channel",)})


def read_declaration(rows: DataFrame) -> dict | None:
    """What declared() put there."""
    text = rows.schema["channel"].metadata.get("protocol")
    return None if text is None else json.loads(text)
