"""Connected components by alternating large-star and small-star joins.

Edges stay distributed; each round is two aggregations and two joins, and a
vertex with very many neighbours is first reduced to its smallest one by
partial aggregation. Lineage is cut once a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of the edges (a, b) but the roots themselves; root is the smallest vertex."""
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    e = tables.checkpoint(edges.filter("a <> b").select("a", "b").distinct())
    before = e.select(mark).first()[0]
    while before["n"]:
        e = tables.checkpoint(_small_star(_large_star(e)))
        now = e.select(mark).first()[0]
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("root"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex with the smallest vertex of its component, for the links of one comparison."""
    v, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(v))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(v))
    return v[moved], v[root[moved]]
