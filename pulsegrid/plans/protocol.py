"""A protocol as Spark steps: inputs, derived streams, thresholds, inhibits, reward, outputs, in the order in which they are added.

It is a thin builder: every call adds columns, Catalyst plans the whole. Window
columns share one partitioning by session; kernels that follow each other share
one Python pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.custom import FUNCTIONS as CUSTOM_FUNCTIONS
from ..functions.custom import KERNELS as CUSTOM_KERNELS
from ..functions.expr import gt
from ..operators import outputs, runs
from ..operators.host import with_kernels
from ..operators.kernels import Kernel
from ..operators.samples import by_session, with_chunk, with_windows


@dataclass
class Protocol:
    fs: float
    chunk: int
    steps: list[tuple[str, object]] = field(default_factory=list)
    gates: dict[str, bool] = field(default_factory=dict)  # inhibit that mutes: is it an artifact
    channels: list[tuple[str, str, Callable[[], Column]]] = field(default_factory=list)

    def stream(self, name: str, expr: Column) -> "Protocol":
        """A stateless stream."""
        self.steps.append(("column", (name, expr)))
        return self

    def window(self, memory: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> "Protocol":
        """Streams that look back at most ``memory`` samples; None for windows from the start."""
        self.steps.append(("window", (memory, columns)))
        return self

    def kernel(self, kernel: Kernel) -> "Protocol":
        self.steps.append(("kernel", kernel))
        return self

    def custom(self, name: str, out: str, *inputs: str, **parameters: object) -> "Protocol":
        """A registered function (functions.custom) of the input columns, or a registered kernel, made with (inputs..., out, parameters)."""
        if name in CUSTOM_FUNCTIONS:
            return self.stream(out, CUSTOM_FUNCTIONS[name](*[F.col(i) for i in inputs]))
        if name not in CUSTOM_KERNELS:
            raise KeyError(f"no custom function or kernel named {name}; there are {sorted([*CUSTOM_FUNCTIONS, *CUSTOM_KERNELS])}")
        return self.kernel(CUSTOM_KERNELS[name](*inputs, out, **parameters))

    def inhibit(self, name: str, metric: str, threshold: Column, action: str = "mute", release_ms: float | None = None, artifact: bool = False, where: Column | None = None) -> "Protocol":
        """<name>_active: metric above threshold; mute and freeze gate with a hangover (<name>_gated), flag only tells.

        ``where``: the samples at which the active block has this inhibit (session.allows); at others it doesn't gate and its hangover waits.
        """
        self.steps.append(("column", (f"{name}_active", gt(F.col(metric), threshold))))
        if action != "flag":
            self.gates[name] = artifact
            release = runs.release_samples(release_ms, self.fs)
            if where is None:
                self.steps.append(("column", (f"{name}_gated", runs.hangover(F.col(f"{name}_active"), release))))
            else:
                self.steps.append(("gate", (F.col(f"{name}_active"), release, where, name)))
        return self

    def muted(self, only: tuple[str, ...] | None = None, artifacts: bool = False) -> Column:
        """Any gate; ``only`` restricts them to those that a block names."""
        names = [n for n, a in self.gates.items() if (only is None or n in only) and (a or not artifacts)]
        return reduce(lambda a, b: a | b, [F.col(f"{n}_gated") for n in names], F.lit(False))

    def dwell(self, name: str, condition: Column, count: int) -> "Protocol":
        self.steps.append(("dwell", (name, condition, count, None)))
        return self

    def output_hold(self, name: str, condition: Column, count: int, suppressed: Column | None = None, channel_active: Column | None = None, reset: Column | None = None) -> "Protocol":
        """A hold that an output reads: muted, suppressed (muted phase) and inactive samples break it; ``reset`` starts it anew."""
        eligible = condition & ~self.muted()
        for c in (None if suppressed is None else ~suppressed, channel_active):
            eligible = eligible if c is None else eligible & c
        self.steps.append(("dwell", (name, eligible, count, reset)))
        return self

    def conditions(self, name: str, parts: list[Column], how: str = "all") -> "Protocol":
        """<name>: all (or any) of the parts, each of which stays readable as <name>_condition_<i>."""
        for i, c in enumerate(parts):
            self.stream(f"{name}_condition_{i}", F.coalesce(c, F.lit(False)))
        each = [F.col(f"{name}_condition_{i}") for i in range(len(parts))]
        return self.stream(name, reduce((lambda a, b: a & b) if how == "all" else (lambda a, b: a | b), each))

    def bands(self, table: dict[str, tuple[float, float]], build: Callable[["Protocol", str, float, float], object]) -> "Protocol":
        """build(protocol, '@band', low, high) for each band: it adds the band's streams under names with that ending."""
        for band, (low, high) in table.items():
            build(self, f"@{band}", low, high)
        return self

    def analog(self, channel: str, value: Column) -> "Protocol":
        outputs.check_kind("analog", channel)
        self.channels.append(("analog", channel, lambda: value))
        return self

    def event(self, channel: str, fires: Column) -> "Protocol":
        outputs.check_kind("event", channel)
        self.channels.append(("event", channel, lambda: fires))
        return self

    def apply(self, samples: DataFrame) -> DataFrame:
        """All streams as columns of the samples."""
        df, pending = with_chunk(samples, self.chunk), []
        for kind, what in [*self.steps, ("end", None)]:
            if kind == "kernel":
                pending.append(what)
                continue
            if pending:
                df, pending = with_kernels(df, pending), []
            if kind == "column":
                df = df.withColumn(*what)
            elif kind == "window":
                memory, columns = what
                df = df.withColumns(columns(by_session())) if memory is None else with_windows(df, memory, columns)
            elif kind == "dwell":
                df = runs.with_dwell(df, what[1], what[2], what[0], what[3])
            elif kind == "gate":
                df = runs.with_gate(df, *what)
        return df

    def emit(self, samples: DataFrame, muted: Column | None = None) -> DataFrame:
        """Rows of all outputs."""
        df = self.apply(samples)
        muted = self.muted() if muted is None else muted
        return outputs.emitted(df, [(kind, channel, value()) for kind, channel, value in self.channels], muted, self.fs)


def fan_out(samples: DataFrame, sites: dict[str, Column], name: str = "site", value: str = "x") -> DataFrame:
    """One session for each site or band: long rows, the name joined to the session, so that all operators run unchanged."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.cast("double").alias("v")) for n, c in sites.items()]))
    out = samples.withColumn("_f", each).withColumn(name, F.col("_f.n")).withColumn(value, F.col("_f.v")).drop("_f")
    return out.withColumn("base_session", F.col("session_id")).withColumn("session_id", F.concat_ws("@", F.col("session_id").cast("string"), name))


def combined(fanned: DataFrame, condition: Column, how: str = "all") -> DataFrame:
    """A condition of all (or any) sites, for each sample of the base session."""
    agg = F.bool_and(condition) if how == "all" else F.bool_or(condition)
    return fanned.groupBy(F.col("base_session").alias("session_id"), "sample_idx").agg(agg.alias("condition"))
