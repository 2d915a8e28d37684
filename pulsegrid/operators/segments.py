"""Kernels on segments of a session, so that one long session is many tasks.

Linear recursions (Smooth without a live tau, Bandpass) are affine in their state: each segment runs from zero, which gives what
it adds to a state; a pass over rows of segments composes these maps and gives each segment the state that it starts from; the
segments then run from there. Kernels of finite memory (Percentile, AutoRange, MovingMean, Fir) get the rows before a segment
that they look back to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host import with_kernels
from .kernels import Bandpass, Columns, Kernel, Smooth
from .samples import INDEX, SEGMENT, SESSION

PIECE = "_piece"
BY = (SESSION, PIECE)


class _Ends(Kernel):
    """A linear kernel from the state zero; its state after what comes together, on the last row of it (elsewhere null)."""

    def __init__(self, kernel: Smooth | Bandpass):
        self.kernel, self.size = kernel, len(kernel.state())
        self.inputs, self.outputs, self.begun = kernel.inputs, {f"_z{i}": "double" for i in range(self.size)}, False

    def step(self, c: Columns) -> Columns:
        if not self.begun:
            self.kernel.set_state(np.zeros(self.size))
            self.begun = True
        self.kernel.step(c)
        out = {name: np.full(len(c[self.inputs[0]]), np.nan) for name in self.outputs}
        for name, v in zip(self.outputs, self.kernel.state()):
            out[name][-1:] = v
        return out


class _Compose(Kernel):
    """Rows of segments in order: the state that each starts from."""

    def __init__(self, kernel: Smooth | Bandpass):
        self.kernel, self.size, self.now = kernel, len(kernel.state()), None
        self.inputs, self.outputs = ["_n", "_x0", *[f"_z{i}" for i in range(self.size)]], {f"_s{i}": "double" for i in range(self.size)}
        self.maps: dict[int, np.ndarray] = {}

    def step(self, c: Columns) -> Columns:
        starts = np.empty((len(c["_n"]), self.size))
        for r, n in enumerate(c["_n"].astype(int).tolist()):
            if self.now is None:
                self.now = self.kernel.warm(float(c["_x0"][r]))
            if n not in self.maps:
                self.maps[n] = self.kernel.carry(n)
            starts[r] = self.now
            self.now = self.maps[n] @ self.now + np.array([c[f"_z{i}"][r] for i in range(self.size)])
        return {f"_s{i}": starts[:, i] for i in range(self.size)}


class _Started(Kernel):
    """A linear kernel from the state in its first row's columns."""

    def __init__(self, kernel: Smooth | Bandpass):
        self.kernel, self.names, self.begun = kernel, [f"_s{i}" for i in range(len(kernel.state()))], False
        self.inputs, self.outputs = [*kernel.inputs, *self.names], kernel.outputs

    def step(self, c: Columns) -> Columns:
        if not self.begun and len(c[self.names[0]]):
            self.kernel.set_state(np.array([c[n][0] for n in self.names]))
            self.begun = True
        return self.kernel.step({n: c[n] for n in self.kernel.inputs})


def with_scan(samples: DataFrame, kernel: Smooth | Bandpass, segment: int = SEGMENT) -> DataFrame:
    """with_kernels for one linear kernel, a task for each segment; equal to the serial one but for rounding (samples that aren't finite spoil what follows, as there)."""
    if len(kernel.inputs) > 1:
        raise ValueError("a live time constant isn't one affine map")
    x, size = kernel.inputs[0], len(kernel.state())
    cut = samples.withColumn(PIECE, F.floor(F.col(INDEX) / segment).cast("long"))
    z = [f"_z{i}" for i in range(size)]
    ends = with_kernels(cut.select(*BY, INDEX, x), [_Ends(kernel)], BY)
    maps = ends.groupBy(*BY).agg(F.count(F.lit(1)).alias("_n"), F.min_by(x, INDEX).alias("_x0"), F.max_by(F.struct(*z), F.when(F.col(z[0]).isNotNull(), F.col(INDEX))).alias("_e"))
    rows = maps.select(SESSION, F.col(PIECE).alias(INDEX), "_n", "_x0", *[F.col(f"_e.{n}").alias(n) for n in z])
    starts = with_kernels(rows, [_Compose(kernel)]).select(F.col(SESSION).alias("_k"), F.col(INDEX).alias("_p"), *[f"_s{i}" for i in range(size)])
    both = cut.join(starts, F.col(SESSION).eqNullSafe(F.col("_k")) & (F.col(PIECE) == F.col("_p"))).drop("_k", "_p")
    return with_kernels(both, [_Started(kernel)], BY).drop(PIECE, *[f"_s{i}" for i in range(size)])


def with_memory(samples: DataFrame, memory: int, kernels: list[Kernel], segment: int = SEGMENT) -> DataFrame:
    """with_kernels for kernels that look at most ``memory`` samples back, a task for each segment and the rows before it."""
    if memory >= segment:
        return with_kernels(samples, kernels)
    at = F.floor(F.col(INDEX) / segment).cast("long")
    own, after = F.struct(at.alias("s"), F.lit(False).alias("warm")), F.struct((at + 1).alias("s"), F.lit(True).alias("warm"))
    pieces = F.when(F.pmod(F.col(INDEX), F.lit(segment)) >= segment - memory, F.array(own, after)).otherwise(F.array(own))
    cut = samples.withColumn("_p", F.explode(pieces)).withColumn(PIECE, F.col("_p.s")).withColumn("_warm", F.col("_p.warm")).drop("_p")
    return with_kernels(cut, kernels, BY).filter(~F.col("_warm")).drop(PIECE, "_warm")
