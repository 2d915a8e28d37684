"""Reading tables, cutting lineage in the folder that driver and executors share, and memory of Python tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all tasks run in this process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or tempfile.mkdtemp(prefix="pulsegrid-")).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df below the shared folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that df hasn't got (names are compared as Spark does, without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column: one aggregate over the scan, a single number to the driver."""
    return int(df.agg(F.sum(F.octet_length(col))).first()[0] or 0)


def bounded_batches(spark: SparkSession) -> None:
    """Rows with texts go to Python in batches of bounded bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, which may not need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at the end of its task."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
