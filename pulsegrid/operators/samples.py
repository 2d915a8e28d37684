"""The sample table: one row a sample of a session, with session_id, sample_idx (from 0, no gaps) and signal columns.

Window operators need one partitioning, by session. Operators of finite memory
may run on *segments* instead: a session is cut every ``segment`` samples and
each piece gets the rows before it that its frames reach back to, so that one
long session is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SESSION, INDEX, CHUNK = "session_id", "sample_idx", "chunk_id"
#: Samples of a piece of a session.
SEGMENT = 1 << 20


def with_index(rows: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Rows as samples: numbered within each session by ``order`` (which has to be total)."""
    w = Window.partitionBy(session).orderBy(*order)
    return rows.withColumn(SESSION, F.col(session)).withColumn(INDEX, (F.row_number().over(w) - 1).cast("long"))


def with_chunk(samples: DataFrame, size: int) -> DataFrame:
    return samples.withColumn(CHUNK, F.floor(F.col(INDEX) / size).cast("long"))


def by_session() -> WindowSpec:
    return Window.partitionBy(SESSION).orderBy(INDEX)


def roll(w: WindowSpec, n: int) -> WindowSpec:
    """The last n samples, fewer at the start."""
    return w.rowsBetween(-(n - 1), 0)


def with_windows(samples: DataFrame, memory: int, columns: Callable[[WindowSpec], dict[str, Column]], segment: int = SEGMENT) -> DataFrame:
    """Add window columns that look at most ``memory`` samples back. columns(w) gives them for an ordered window."""
    if memory >= segment:
        return samples.withColumns(columns(by_session()))
    at = F.floor(F.col(INDEX) / segment).cast("long")
    own, after = F.struct(at.alias("s"), F.lit(False).alias("warm")), F.struct((at + 1).alias("s"), F.lit(True).alias("warm"))
    pieces = F.when(F.pmod(F.col(INDEX), F.lit(segment)) >= segment - memory, F.array(own, after)).otherwise(F.array(own))
    w = Window.partitionBy(SESSION, "_piece").orderBy(INDEX)
    cut = samples.withColumn("_p", F.explode(pieces)).withColumn("_piece", F.col("_p.s")).withColumn("_warm", F.col("_p.warm"))
    return cut.withColumns(columns(w)).filter(~F.col("_warm")).drop("_p", "_piece", "_warm")
