"""Functions of a protocol's own: stateless ones as pandas UDFs over Arrow batches, stateful ones as kernels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..operators.kernels import Kernel

FUNCTIONS: dict[str, Callable] = {}
KERNELS: dict[str, type[Kernel]] = {}


def function(name: str, kind: str = "double"):
    """Register f(series, ...) -> series."""

    def put(f: Callable[..., pd.Series]):
        FUNCTIONS[name] = F.pandas_udf(f, kind)
        return FUNCTIONS[name]

    return put


def kernel(name: str):
    def put(k: type[Kernel]) -> type[Kernel]:
        KERNELS[name] = k
        return k

    return put
