"""Helpers shared by the operators: narrow inputs, stored intermediate tables, packed arrays."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.session import scratch_dir, stored

#: A word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

_FILE_ROWS = 100_000
_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long: no more than ``rows`` of them go to Python at once in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def narrow(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(id, text)`` of ``df`` with null texts as empty ones; no other column can clash from here on."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def keep(df: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, lineage cut; the folder goes when the session ends.

    Where at most ``rows`` rows are known to come, they go to as few files as hold ``_FILE_ROWS`` each.
    """
    if rows is not None:
        df = df.coalesce(min(partitions(df.sparkSession), -(-rows // _FILE_ROWS) or 1))
    out = stored(df, purpose)
    path = out.inputFiles()[0].rpartition("/")[0] if out.inputFiles() else None
    if path:
        _scratch.append((df.sparkSession, path))
    return out


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared folder, gone when the session ends."""
    path = scratch_dir(spark, purpose)
    _scratch.append((spark, path))
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch files that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            discard(spark, path)
        except Exception:  # the session may have ended before: nothing is left to ask
            return


def release() -> None:
    """Give memory that is free in this process back to the system, which Python's and C's allocators keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a task's batches; the worker process outlives its tasks, what they needed goes with them."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(key: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def planes(values: np.ndarray) -> bytes:
    """The bytes of ``values``, all first bytes, then all second ones, ...: sorted or small numbers compress well so."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def bounds(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the length at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
