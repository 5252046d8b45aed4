"""What the operators share: the folder that driver and executors see, and reading of the tables."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, shared_path, stored  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict = {}


def kept(key, make):
    """What a worker process keeps from task to task, such as a table of words: one thing at a time, so that what one
    operator has gathered doesn't stay beside the next one's."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget():
    """Drops what the worker kept for an operator that ran in it before, and gives the memory of all that it has freed
    back to the system."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_batches(df: DataFrame, most_bytes: str = "4m") -> DataFrame:
    """df, for a Python worker: from now on its session sends about most_bytes at once, whatever the length of texts, so
    that a worker needs no more memory for long texts than for many."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)
    return df


@contextmanager
def batch_bytes(spark: SparkSession, most: str = "4m"):
    """Within it, jobs send about ``most`` bytes to a Python worker at once; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ascii_lower(col):
    """A-Z only, as both engines and Python can do it alike."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_hint(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df, to be broadcast if its rows hold at most most_bytes, by a count and, where columns have no fixed width, by
    their lengths; beyond that the join shuffles. For stored tables."""
    fixed = sum(_WIDTH.get(kind, 0) for _, kind in df.dtypes)
    sizes = [F.size(c) * 8 if kind.startswith("array<") else F.octet_length(c) for c, kind in df.dtypes if kind not in _WIDTH]
    other = sum(sizes, F.lit(0)) if sizes else F.lit(0)
    total = df.agg((F.count("*") * (fixed + 8) + F.coalesce(F.sum(other), F.lit(0))).alias("bytes")).first()[0]
    return F.broadcast(df) if total <= most_bytes else df


_WIDTH = {"bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "boolean": 1}
