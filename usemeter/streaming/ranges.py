"""Folders written batch by batch: ``part=<first>-<last>``, merged from time to time.

A folder counts once its writer has finished it (``_SUCCESS``).  A merged folder covers a range of
batches and supersedes the folders inside that range, so readers never count a batch twice, and a
batch that is repeated after it was merged changes nothing.  Merges go by levels: runs of ``fanout``
batches become one folder, ``fanout`` of these the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PART = re.compile(r"part=(\d+)-(\d+)$")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_finished(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(target)


def finished(spark: SparkSession, out: str) -> list[tuple[int, int, str]]:
    """Finished folders as (first batch, last batch, path); their number is that of open batches."""
    fs, root = _fs(spark, out)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        path = status.getPath().toString()
        named = _PART.search(path)
        if named and is_finished(spark, path):
            found.append((int(named[1]), int(named[2]), path))
    return sorted(found)


def current(spark: SparkSession, out: str, before: int | None = None) -> list[tuple[int, int, str]]:
    """The finished folders that no wider one supersedes, in order; only batches ``before`` one."""
    found = [f for f in finished(spark, out) if before is None or f[1] < before]
    wider = lambda f, g: g[0] <= f[0] and f[1] <= g[1] and g[:2] != f[:2]
    return [f for f in found if not any(wider(f, g) for g in found)]


def part(out: str, first: int, last: int) -> str:
    return f"{out}/part={first}-{last}"


def span_of(batch_id: int, fanout: int) -> int:
    """Batches of the widest full run that ``batch_id`` completes: the largest power of ``fanout``."""
    span = 1
    while (batch_id + 1) % (span * fanout) == 0:
        span *= fanout
    return span


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def merge_levels(
    spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame], batch_id: int, fanout: int,
    write: Callable[[DataFrame, str], None] = _overwrite,
) -> tuple[int, int] | None:
    """One folder for the run of batches that ``batch_id`` completes, if any; its first and last batch.

    A run has ``fanout ** k`` batches, so a batch's rows are written again once for each power: n log n in
    all over n batches, and fewer than ``fanout`` folders of each length are open.  Folders that this merge
    supersedes stay until the next one, for readers that are under way.
    """
    span = span_of(batch_id, fanout)
    everything = finished(spark, out)
    valid = current(spark, out)
    now = [f for f in valid if batch_id - span < f[0] and f[1] <= batch_id]
    if span == 1 or len(now) < 2:
        return None
    first = now[0][0]
    write(merge(spark.read.parquet(*[f[2] for f in now])), part(out, first, batch_id))
    for superseded in everything:
        if superseded not in valid and superseded[1] <= batch_id:
            fs, target = _fs(spark, superseded[2])
            fs.delete(target, True)
    return first, batch_id


def forget_others(spark: SparkSession, side: str, out: str, upto: int) -> None:
    """Deletes folders below ``side`` of batches up to ``upto`` that have no folder below ``out`` any more."""
    kept = {f[:2] for f in finished(spark, out)}
    for first, last, path in finished(spark, side):
        if (first, last) not in kept and last <= upto:
            fs, target = _fs(spark, path)
            fs.delete(target, True)


def newest(spark: SparkSession, out: str) -> str | None:
    """The last finished folder of a table that is written whole per batch; older ones are deleted."""
    found = sorted(finished(spark, out), key=lambda f: f[1])
    for _, _, path in found[:-2]:
        fs, target = _fs(spark, path)
        fs.delete(target, True)
    return found[-1][2] if found else None


def forget_commit(spark: SparkSession, checkpoint: str, batch_id: int) -> None:
    """Takes back a stream's commit of a batch, as if it had been stopped before: it will be repeated."""
    fs, target = _fs(spark, f"{checkpoint}/commits/{batch_id}")
    fs.delete(target, False)
