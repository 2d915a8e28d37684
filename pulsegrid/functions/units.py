"""Physical units of streams: exponents of time, voltage and temperature, checked when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass


class UnitError(ValueError):
    pass


@dataclass(frozen=True)
class Unit:
    time: int = 0
    voltage: int = 0
    temperature: int = 0

    def __mul__(self, o: "Unit") -> "Unit":
        return Unit(self.time + o.time, self.voltage + o.voltage, self.temperature + o.temperature)

    def __truediv__(self, o: "Unit") -> "Unit":
        return Unit(self.time - o.time, self.voltage - o.voltage, self.temperature - o.temperature)

    def sqrt(self) -> "Unit":
        if any(e % 2 for e in (self.time, self.voltage, self.temperature)):
            raise UnitError("sqrt needs even exponents")
        return Unit(self.time // 2, self.voltage // 2, self.temperature // 2)

    def same(self, o: "Unit") -> "Unit":
        if self != o:
            raise UnitError(f"{self} and {o} don't go together")
        return self


ONE, SECOND, VOLT, CELSIUS = Unit(), Unit(time=1), Unit(voltage=1), Unit(temperature=1)
#: Unit and factor to the base (milliseconds, microvolts, degrees) of each written unit.
UNITS: dict[str, tuple[Unit, float]] = {
    "": (ONE, 1.0), "%": (ONE, 1.0), "Hz": (ONE / SECOND, 1.0), "ms": (SECOND, 1.0), "s": (SECOND, 1000.0), "min": (SECOND, 60_000.0),
    "uV": (VOLT, 1.0), "uV2": (VOLT * VOLT, 1.0), "C": (CELSIUS, 1.0),
}


def milliseconds(value: float, unit: str) -> float:
    kind, factor = UNITS[unit]
    if kind != SECOND:
        raise UnitError(f"{unit} is no time")
    return value * factor


def samples(value: float, unit: str, fs: float) -> int:
    """A duration in whole samples, halves to even."""
    return round(milliseconds(value, unit) * fs / 1000.0)
