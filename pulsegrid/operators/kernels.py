"""Ordered recursions that no window expresses, one class each: step(columns of consecutive samples) -> columns, with state kept between calls.

The same objects run in batch (host.py: sorted partitions, batch after batch, so
a session is never held as a whole) and under Structured Streaming
(streaming/live.py: kept in typed state between micro-batches, by Kernel.save and Kernel.load).
"""

from __future__ import annotations

import bisect
import copy
import math
from collections import deque
from collections.abc import Callable

import numpy as np

from ..functions import filters

Columns = dict[str, np.ndarray]


class Kernel:
    """inputs: names of columns; outputs: names and Spark types; chunked: whether values depend on how samples are cut into chunks; memory: the attributes that are state."""

    inputs: list[str]
    outputs: dict[str, str]
    chunked = False
    memory: tuple[str, ...] = ()

    def step(self, c: Columns) -> Columns:
        raise NotImplementedError

    def step_chunks(self, c: Columns, bounds: np.ndarray) -> Columns:
        """Several whole chunks at once; chunk i is bounds[i] to bounds[i + 1]."""
        parts = [self.step({n: v[a:b] for n, v in c.items()}) for a, b in zip(bounds[:-1], bounds[1:])]
        return {n: np.concatenate([p[n] for p in parts]) for n in self.outputs}

    def anew(self) -> "Kernel":
        """A kernel that starts anew, of one that hasn't been stepped: tables and other arrays are shared, containers aren't."""
        new = object.__new__(type(self))
        for name, v in vars(self).items():
            if isinstance(v, Kernel):
                v = v.anew()
            elif not isinstance(v, (str, int, float, tuple, np.ndarray, type(None))) and not callable(v):
                v = copy.copy(v) if isinstance(v, (deque, list, dict, set)) else copy.deepcopy(v)
            setattr(new, name, v)
        return new

    def save(self) -> dict[str, tuple[str, list[float]]]:
        """State as numbers: attribute (with dots for kernels within) to its kind and values. Only what ``memory`` names."""
        out: dict[str, tuple[str, list[float]]] = {}
        for name in self.memory:
            v = getattr(self, name)
            if isinstance(v, Kernel):
                out |= {f"{name}.{k}": x for k, x in v.save().items()}
            elif isinstance(v, np.ndarray):
                out[name] = ("array:" + ",".join(map(str, v.shape)), v.astype(float).reshape(-1).tolist())
            elif isinstance(v, deque):
                out[name] = ("deque", [float(x) for x in v])
            elif v is None:
                out[name] = ("none", [])
            else:
                out[name] = (type(v).__name__, [float(v)])
        return out

    def load(self, state: dict[str, tuple[str, list[float]]]) -> None:
        """Go on from save(), in a kernel of the same parameters."""
        for name in self.memory:
            old = getattr(self, name)
            if isinstance(old, Kernel):
                old.load({k[len(name) + 1 :]: x for k, x in state.items() if k.startswith(f"{name}.")})
                continue
            if name not in state:
                continue
            kind, values = state[name]
            if kind.startswith("array:"):
                v = np.array(values).reshape([int(n) for n in kind[6:].split(",")])
            elif kind == "deque":
                v = deque(values, maxlen=old.maxlen if isinstance(old, deque) else None)
            else:
                v = None if kind == "none" else {"bool": bool, "int": int}.get(kind, float)(values[0])
            setattr(self, name, v)


class Smooth(Kernel):
    """y = y + alpha (x - y), from y[0] = x[0]; blocks of samples by one triangular product.

    ``tau_column``: a live time constant in seconds; what isn't above 0 leaves the last one, and y goes on from where it is.
    """

    BLOCK = 64
    memory = ("y", "tau")

    def load(self, state):
        super().load(state)
        self.retune(self.tau)

    def __init__(self, x: str, out: str, tau_s: float, fs: float, tau_column: str | None = None):
        self.inputs, self.outputs = [x, *([tau_column] if tau_column else [])], {out: "double"}
        self.fs, self.y = fs, None
        self.retune(tau_s)

    def retune(self, tau_s: float) -> None:
        self.tau, alpha, k = tau_s, filters.smoothing_factor(tau_s, self.fs), np.arange(self.BLOCK)
        self.table = np.where(k[:, None] >= k, alpha * (1.0 - alpha) ** np.maximum(k[:, None] - k, 0), 0.0)
        self.decay = (1.0 - alpha) ** (k + 1)

    def state(self) -> np.ndarray:
        return np.array([0.0 if self.y is None else self.y])

    def set_state(self, state: np.ndarray) -> None:
        self.y = float(state[0])

    def warm(self, x0: float) -> np.ndarray:
        return np.array([x0])

    def carry(self, n: int) -> np.ndarray:
        """What n samples do to a state: the matrix of an affine map."""
        return np.array([[(1.0 - filters.smoothing_factor(self.tau, self.fs)) ** n]])

    def _run(self, x: np.ndarray) -> np.ndarray:
        y = np.empty(len(x))
        for i in range(0, len(x), self.BLOCK):
            b = x[i : i + self.BLOCK]
            n = len(b)
            y[i : i + n] = self.table[:n, :n] @ b + self.decay[:n] * self.y
            self.y = y[i + n - 1]
        return y

    def step(self, c: Columns) -> Columns:
        x = c[self.inputs[0]].astype(float)
        if len(x) and self.y is None:
            self.y = x[0]
        if len(self.inputs) == 1:
            return {next(iter(self.outputs)): self._run(x)}
        tau = c[self.inputs[1]].astype(float)
        cuts = [0, *(np.flatnonzero(tau[1:] != tau[:-1]) + 1).tolist(), len(x)]
        parts = [np.empty(0)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b and tau[a] > 0 and tau[a] != self.tau:
                self.retune(float(tau[a]))
            parts.append(self._run(x[a:b]))
        return {next(iter(self.outputs)): np.concatenate(parts)}


class Bandpass(Kernel):
    """Second-order sections, each started as if the first sample had been there forever; blocks of samples by one triangular product a section."""

    BLOCK = 64
    memory = ("z",)

    def __init__(self, x: str, out: str, low: float, high: float, fs: float, order: int = 4, kind: str = "butterworth", attenuation_db: float = 40.0):
        self.inputs, self.outputs = [x], {out: "double"}
        self.sos = filters.bandpass_sos(low, high, fs, order, kind, attenuation_db)
        self.z: np.ndarray | None = None
        self.blocks = tuple(self._block(*row) for row in np.asarray(self.sos)[:, [0, 1, 2, 4, 5]].tolist())

    def state(self) -> np.ndarray:
        return (np.zeros((len(self.blocks), 2)) if self.z is None else self.z).reshape(-1)

    def set_state(self, state: np.ndarray) -> None:
        self.z = np.array(state, float).reshape(-1, 2)

    def warm(self, x0: float) -> np.ndarray:
        return (filters.warm_state(self.sos) * x0).reshape(-1)

    def carry(self, n: int) -> np.ndarray:
        """What n samples do to a state: the matrix of an affine map; its columns are what a sample of 0 makes of unit states."""
        size = 2 * len(self.blocks)
        one, k = np.empty((size, size)), self.anew()
        for i in range(size):
            k.set_state(np.eye(size)[i])
            k.step({self.inputs[0]: np.zeros(1)})
            one[:, i] = k.state()
        return np.linalg.matrix_power(one, n)

    def _block(self, b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For n samples x and a state z: y = G x + H z (rows up to n), and the state after them (powers[n], gain columns)."""
        n, move, push = self.BLOCK, np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = np.empty((n + 1, 2, 2))
        powers[0] = np.eye(2)
        for i in range(n):
            powers[i + 1] = move @ powers[i]
        h = powers[:n, 0, :]  # y sees z through its first component
        response = np.concatenate([[b0], (h @ push)[: n - 1]])
        k = np.arange(n)
        g = np.where(k[:, None] >= k, response[np.maximum(k[:, None] - k, 0)], 0.0)
        pushed = np.stack([powers[i] @ push for i in range(n)])  # of a sample i places before the end
        return g, h, powers, pushed

    def step(self, c: Columns) -> Columns:
        x = c[self.inputs[0]].astype(float)
        if not len(x):
            return {next(iter(self.outputs)): x}
        if self.z is None:
            self.z = filters.warm_state(self.sos) * x[0]
        z = self.z.copy()
        for s, (g, h, powers, pushed) in enumerate(self.blocks):
            y = np.empty(len(x))
            for i in range(0, len(x), self.BLOCK):
                b = x[i : i + self.BLOCK]
                n = len(b)
                y[i : i + n] = g[:n, :n] @ b + h[:n] @ z[s]
                z[s] = powers[n] @ z[s] + b[::-1] @ pushed[:n]
            x = y
        self.z = z
        return {next(iter(self.outputs)): x}


class MovingMean(Kernel):
    """Mean (of squares) of the last n samples, by running sums over each block of at most n samples and what is held."""

    memory = ("held",)

    def __init__(self, x: str, out: str, n: int, square: bool = False):
        self.inputs, self.outputs, self.square, self.n = [x], {out: "double"}, square, max(1, n)
        self.held = np.empty(0)

    def step(self, c: Columns) -> Columns:
        x = c[self.inputs[0]].astype(float)
        x = x * x if self.square else x
        y, block = np.empty(len(x)), max(self.n, 256)
        for i in range(0, len(x), block):
            b = x[i : i + block]
            a = np.concatenate([self.held, b])
            ends = np.arange(len(self.held), len(a)) + 1
            starts = np.maximum(ends - self.n, 0)
            if np.isfinite(a).all():
                sums = np.concatenate([[0.0], np.cumsum(a)])
                y[i : i + len(b)] = (sums[ends] - sums[starts]) / (ends - starts)
            else:  # what isn't finite counts while it is in the window
                y[i : i + len(b)] = [a[p:q].mean() for p, q in zip(starts, ends)]
            self.held = a[max(0, len(a) - self.n) :]
        return {next(iter(self.outputs)): y}


class Bandpower(Kernel):
    """Mean square of the band over the last n samples; the band's top is kept under 0.99 of half the rate."""

    memory = ("band", "mean")

    def __init__(self, x: str, out: str, low: float, high: float, n: int, fs: float):
        self.inputs, self.outputs = [x], {out: "double"}
        self.band = Bandpass(x, "band", low, min(high, 0.99 * fs / 2), fs)
        self.mean = MovingMean("band", out, n, square=True)

    def step(self, c: Columns) -> Columns:
        return self.mean.step(self.band.step(c))


def interpolated(s: list[float], pct: float) -> float:
    """Percentile of sorted values, linear between neighbours."""
    at = (len(s) - 1) * pct / 100.0
    lo = math.floor(at)
    hi = min(lo + 1, len(s) - 1)
    return s[lo] + (s[hi] - s[lo]) * (at - lo)


class Percentile(Kernel):
    """Rolling percentile of the last n ingested samples in a sorted list: O(log n) search a sample. ``start`` names two columns, a value and a count from another session's export() to begin with (read at the first sample). ``ingest`` names a boolean column; where it is false the value stays."""

    memory = ("held",)

    def load(self, state):
        super().load(state)
        self.bad = sum(map(math.isnan, self.held))
        self.sorted = sorted(v for v in self.held if not math.isnan(v))

    def __init__(self, x: str, out: str, pct: float, n: int, ingest: str | None = None, pct_column: str | None = None, start: tuple[str, str] | None = None):
        self.inputs, self.outputs = [x, *([ingest] if ingest else []), *([pct_column] if pct_column else []), *(start or ())], {out: "double"}
        self.start = start
        self.ingest, self.pct_column, self.pct, self.n = ingest, pct_column, pct, max(1, n)
        self.held: deque[float] = deque()
        self.sorted: list[float] = []
        self.bad = 0

    def add(self, v: float) -> None:
        self.held.append(v)
        if math.isnan(v):
            self.bad += 1
        else:
            bisect.insort(self.sorted, v)
        if len(self.held) > self.n:
            old = self.held.popleft()
            if math.isnan(old):
                self.bad -= 1
            else:
                del self.sorted[bisect.bisect_left(self.sorted, old)]

    def value(self, pct: float | None = None) -> float:
        if self.bad:
            return math.nan
        return interpolated(self.sorted, min(100.0, max(0.0, self.pct if pct is None else pct))) if self.sorted else 0.0

    def step(self, c: Columns) -> Columns:
        y = []
        x = c[self.inputs[0]].astype(float).tolist()
        if self.start and x and not self.held:
            value, n = (float(c[k][0]) for k in self.start)
            if n > 0 and not math.isnan(value):
                self.seed(value, int(n))
        on = c[self.ingest].tolist() if self.ingest else [True] * len(x)
        pct = c[self.pct_column].tolist() if self.pct_column else [None] * len(x)
        for v, take, p in zip(x, on, pct):
            if take:
                self.add(v)
            y.append(self.value(p))
        return {next(iter(self.outputs)): np.array(y)}

    def export(self) -> dict[str, float]:
        return {"value": self.value(), "target_pct": self.pct, "n_eff": len(self.held)}

    def seed(self, value: float, n: int) -> None:
        """Refill with a constant."""
        self.held.clear()
        self.sorted.clear()
        self.bad = 0
        for _ in range(min(n, self.n)):
            self.add(value)


class Autocorrelation(Kernel):
    """Of the last n samples about their mean at one lag, in [-1, 1]; 0 with fewer than lag + 2 samples or no variance. Running sums of values, squares and lagged products about a level near the samples."""

    memory = ("held",)

    def __init__(self, x: str, out: str, lag: int, n: int):
        if n < lag + 2:
            raise ValueError("the window has to hold lag + 2 samples")
        self.inputs, self.outputs, self.lag, self.n = [x], {out: "double"}, lag, n
        self.held = np.empty(0)

    def step(self, c: Columns) -> Columns:
        x = c[self.inputs[0]].astype(float)
        y, block = np.empty(len(x)), max(self.n, 256)
        for i in range(0, len(x), block):
            a = np.concatenate([self.held, x[i : i + block]])
            y[i : i + block] = self._block(a, len(self.held))
            self.held = a[max(0, len(a) - self.n) :]
        return {next(iter(self.outputs)): y}

    def _block(self, a: np.ndarray, old: int) -> np.ndarray:
        k, ends = self.lag, np.arange(old, len(a)) + 1
        starts = np.maximum(ends - self.n, 0)
        size = ends - starts
        if not np.isfinite(a).all():
            return np.array([self._one(a[p:q]) for p, q in zip(starts, ends)])
        d = a - a.mean()
        run = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        s, s2, products = run(d), run(d * d), run(np.concatenate([np.zeros(k), d[k:] * d[: len(d) - k]]) if len(d) > k else np.zeros(len(d)))
        whole = s[ends] - s[starts]
        mean = whole / size
        total = s2[ends] - s2[starts] - size * mean * mean
        inner = np.minimum(starts + k, ends)
        pairs = products[ends] - products[inner]
        later, earlier = s[ends] - s[inner], s[np.maximum(ends - k, starts)] - s[starts]
        top = pairs - mean * (later + earlier) + (size - k) * mean * mean
        # what rounding leaves of no variance isn't one
        fine = (size >= k + 2) & (total > 1e-12 * np.maximum(s2[ends] - s2[starts], 1e-300))
        return np.where(fine, np.clip(top / np.where(fine, total, 1.0), -1.0, 1.0), 0.0)

    def _one(self, w: np.ndarray) -> float:
        if len(w) < self.lag + 2:
            return 0.0
        d = w - w.mean()
        total = float((d * d).sum())
        return 0.0 if total <= 0 else float(np.clip((d[self.lag :] * d[: len(d) - self.lag]).sum() / total, -1.0, 1.0))


class Map(Kernel):
    """A stateless stream: f(columns as arrays) -> array."""

    def __init__(self, inputs: list[str], out: str, f: Callable[..., np.ndarray], kind: str = "double"):
        self.inputs, self.outputs, self.f = inputs, {out: kind}, f

    def step(self, c: Columns) -> Columns:
        return {next(iter(self.outputs)): self.f(*[c[n] for n in self.inputs])}


class Fir(Kernel):
    """Sum of taps[j] * x[i - j], zeros before the start: windows.fir with its memory kept; complex taps give the magnitude."""

    memory = ("past",)
    #: From so many taps on, blocks are convolved by FFT (overlap-save).
    LONG = 64

    def __init__(self, x: str, out: str, taps: np.ndarray):
        self.inputs, self.outputs, self.taps = [x], {out: "double"}, np.asarray(taps)
        self.past = np.zeros(len(self.taps) - 1)

    def step(self, c: Columns) -> Columns:
        x = np.concatenate([self.past, c[self.inputs[0]].astype(float)])
        self.past = x[len(x) - len(self.past) :]
        y = np.empty(0) if len(x) < len(self.taps) else np.convolve(x, self.taps, "valid") if len(self.taps) < self.LONG or not np.isfinite(x).all() else self._overlap_save(x)
        return {next(iter(self.outputs)): np.abs(y) if np.iscomplexobj(y) else y}


    def _overlap_save(self, x: np.ndarray) -> np.ndarray:
        """Blocks of twice to four times the taps, each of which gives what its first taps - 1 samples don't spoil."""
        n = len(self.taps)
        size = 1 << (2 * n - 1).bit_length()
        good = size - n + 1
        blocks = -(-(len(x) - n + 1) // good)
        padded = np.concatenate([x, np.zeros(blocks * good + n - 1 - len(x))])
        parts = np.lib.stride_tricks.sliding_window_view(padded, size)[::good][:blocks]
        real = not np.iscomplexobj(self.taps)
        there, back = (np.fft.rfft, np.fft.irfft) if real else (np.fft.fft, np.fft.ifft)
        y = back(there(parts, size) * there(self.taps, size), size)[:, n - 1 :]
        return y.reshape(-1)[: len(x) - n + 1]


class Gate(Kernel):
    """Active, or at most ``release`` samples after the last active one: runs.hangover with its memory kept."""

    memory = ("ago",)

    def __init__(self, active: str, out: str, release: int):
        self.inputs, self.outputs, self.release = [active], {out: "boolean"}, release
        self.ago: float = math.inf

    def step(self, c: Columns) -> Columns:
        on = c[self.inputs[0]].astype(bool)
        at = np.arange(len(on))
        last = np.maximum.accumulate(np.where(on, at, -1 - self.ago)) if len(on) else np.empty(0)
        ago = at - last
        self.ago = float(ago[-1]) if len(on) else self.ago
        return {next(iter(self.outputs)): ago <= self.release}


class AutoRange(Kernel):
    memory = ("track",)

    def __init__(self, x: str, out: str, n: int, low: float = 5.0, high: float = 95.0, start: tuple[str, str, str] | None = None):
        self.inputs, self.outputs, self.low, self.high, self.start = [x, *(start or ())], {out: "double"}, low, high, start
        self.track = Percentile(x, "p", low, n)

    def step(self, c: Columns) -> Columns:
        y = []
        if self.start and len(c[self.inputs[0]]) and not self.track.held:
            low, high, n = (float(c[k][0]) for k in self.start)
            if n > 0 and not math.isnan(low + high):
                self.seed(low, high, int(n))
        for v in c[self.inputs[0]].astype(float).tolist():
            self.track.add(v)
            lo, hi = self.track.value(self.low), self.track.value(self.high)
            q = (v - lo) / max(hi - lo, 1e-9)
            y.append(q if math.isnan(q) else min(1.0, max(0.0, q)))
        return {next(iter(self.outputs)): np.array(y)}

    def export(self) -> dict[str, float]:
        return {"low": self.track.value(self.low), "high": self.track.value(self.high), "n_eff": len(self.track.held)}

    def seed(self, low: float, high: float, n: int) -> None:
        """Refill with a ramp."""
        self.track.seed(low, 0)
        for v in np.linspace(low, high, min(n, self.track.n)).tolist():
            self.track.add(v)


class Dwell(Kernel):
    """Streak of a condition with a tolerance for dips; samples that aren't observable freeze it. Gives <out>_holds and <out>_event.

    ``count_column``: a live duration in samples; a new one starts the streak anew, what isn't above 0 leaves the last one. ``reset``
    names a boolean column: such a sample starts the streak anew, too.
    """

    memory = ("count", "streak", "dip", "held")

    def __init__(self, condition: str, out: str, count: int, tolerance: int = 0, observable: str | None = None, count_column: str | None = None, reset: str | None = None):
        self.inputs, self.outputs = [condition, *[n for n in (observable, count_column, reset) if n]], {f"{out}_holds": "boolean", f"{out}_event": "boolean"}
        self.count_column, self.reset = count_column, reset
        self.out, self.count, self.tolerance, self.observable = out, max(1, count), tolerance, observable
        self.streak = self.dip = 0
        self.held = False

    def step(self, c: Columns) -> Columns:
        holds, events = [], []
        cond = c[self.inputs[0]].tolist()
        seen = c[self.observable].tolist() if self.observable else [True] * len(cond)
        counts = c[self.count_column].astype(float).tolist() if self.count_column else [0.0] * len(cond)
        again = c[self.reset].tolist() if self.reset else [False] * len(cond)
        for v, ok, count, anew in zip(cond, seen, counts, again):
            if anew:
                self.streak, self.dip, self.held = 0, 0, False
            if count > 0 and max(1, round(count)) != self.count:
                self.count, self.streak, self.dip, self.held = max(1, round(count)), 0, 0, False
            if ok:
                if v:
                    self.streak, self.dip = self.streak + 1, 0
                else:
                    self.dip += 1
                    if self.dip > self.tolerance:
                        self.streak = 0
            now = self.streak >= self.count
            holds.append(now)
            events.append(now and not self.held)
            self.held = now
        return {f"{self.out}_holds": np.array(holds, bool), f"{self.out}_event": np.array(events, bool)}


class DwellRearm(Kernel):
    """One event for each arming: it re-arms once the condition has been out for ``rearm`` samples; a dip beyond the tolerance counts as out from its start."""

    memory = ("streak", "dip", "away", "armed")

    def __init__(self, condition: str, out: str, count: int, rearm: int, tolerance: int = 0, observable: str | None = None):
        self.inputs, self.outputs = [condition, *([observable] if observable else [])], {f"{out}_holds": "boolean", f"{out}_event": "boolean"}
        self.out, self.count, self.rearm, self.tolerance, self.observable = out, max(1, count), max(1, rearm), tolerance, observable
        self.streak = self.dip = self.away = 0
        self.armed = True

    def step(self, c: Columns) -> Columns:
        holds, events = [], []
        cond = c[self.inputs[0]].tolist()
        seen = c[self.observable].tolist() if self.observable else [True] * len(cond)
        for v, ok in zip(cond, seen):
            fire = False
            if ok:
                if v:
                    self.streak, self.dip, self.away = self.streak + 1, 0, 0
                    if self.armed and self.streak >= self.count:
                        fire, self.armed = True, False
                else:
                    self.dip += 1
                    if self.dip > self.tolerance:
                        self.away = self.dip if self.away == 0 else self.away + 1
                        self.streak = 0
                        if self.away >= self.rearm:
                            self.armed = True
            holds.append(self.streak >= self.count)
            events.append(fire)
        return {f"{self.out}_holds": np.array(holds, bool), f"{self.out}_event": np.array(events, bool)}


def segment_length(low: float, high: float, fs: float, bins: int = 3) -> int:
    """The shortest Welch segment with three bin centres in the band."""
    start = max(8, int(fs // 4), math.ceil((bins - 1) * fs / (high - low)))
    stop = max(8, int(fs // 4), math.ceil(bins * fs / (high - low)))
    return next((n for n in range(start, stop) if sum(low <= k * fs / n <= high for k in range(n // 2 + 1)) >= bins), stop)


class Coherence(Kernel):
    """Magnitude-squared coherence in a band by Welch's method over the last n samples; one value for each chunk that step() gets."""

    chunked = True
    memory = ("a", "b")

    def __init__(self, a: str, b: str, out: str, low: float, high: float, n: int, fs: float):
        self.inputs, self.outputs, self.n = [a, b], {out: "double"}, n
        self.size = segment_length(low, high, fs)
        if n < 2 * self.size:
            raise ValueError(f"the window has to hold two segments of {self.size} samples")
        self.hop = self.size - self.size // 2
        f = np.arange(self.size // 2 + 1) * fs / self.size
        self.band = (f >= low) & (f <= high)
        self.taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(self.size) / self.size)
        self.a, self.b = np.empty(0), np.empty(0)  # the last n samples

    def _spectra(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the segments that begin at ``starts``: bins of the band."""
        parts = np.lib.stride_tricks.sliding_window_view(x, self.size)[starts]
        return np.fft.rfft((parts - parts.mean(1, keepdims=True)) * self.taper)[:, self.band]

    def step(self, c: Columns) -> Columns:
        return self.step_chunks(c, np.array([0, len(c[self.inputs[0]])]))

    def step_chunks(self, c: Columns, bounds: np.ndarray) -> Columns:
        """Each segment's spectrum is computed once; a chunk's means are differences of running sums over the segments of its grid."""
        x, y = (np.concatenate([held, c[n].astype(float)]) for held, n in zip((self.a, self.b), self.inputs))
        old = len(self.a)
        ends = old + bounds[1:]
        first = np.maximum(ends - self.n, 0)
        count = np.where(ends - first >= self.size + self.hop, (ends - first - self.size) // self.hop + 1, 0)
        values = np.zeros(len(ends))
        finite = np.isfinite(x).all() and np.isfinite(y).all()
        for grid in np.unique(first[count > 0] % self.hop):
            at = np.flatnonzero((count > 0) & (first % self.hop == grid))
            low, high = first[at].min(), (first[at] + count[at] * self.hop).max()
            p, q = (self._spectra(v, np.arange(low, high, self.hop)) for v in (x, y))
            terms = np.stack([(p.conj() * q).real, (p.conj() * q).imag, np.abs(p) ** 2, np.abs(q) ** 2])
            i = (first[at] - low) // self.hop
            if finite:
                sums = np.concatenate([np.zeros((4, 1, terms.shape[2])), np.cumsum(terms, 1)], 1)
                means = (sums[:, i + count[at]] - sums[:, i]) / count[at][:, None]
            else:
                means = np.stack([terms[:, k : k + n].mean(1) for k, n in zip(i, count[at])], 1)
            with np.errstate(all="ignore"):
                # a power that is nothing beside what running sums round away counts as none
                power = means[2] * means[3]
                msc = np.where(power > 0, (means[0] ** 2 + means[1] ** 2) / power, 0.0)
            values[at] = np.clip(np.nan_to_num(msc, nan=0.0, posinf=0.0, neginf=0.0).mean(1), 0.0, 1.0)
        self.a, self.b = x[max(0, len(x) - self.n) :], y[max(0, len(y) - self.n) :]
        return {next(iter(self.outputs)): np.repeat(values, np.diff(bounds))}
