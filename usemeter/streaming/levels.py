"""Keyed states of a stream, in levels: a batch reads the rows of its keys and writes its own.

Each micro-batch adds a level with the rows that it sets.  A level is a table clustered by its key, with a
sketch of its keys beside it, so a lookup skips the levels that hold none of its keys, and of the others all but
the row groups and pages with their slots: what a batch reads depends on its keys, not on how much there is.
Levels are merged as in ``ranges``.  A base, written once, may lie below them all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.operators.clustering import (
    SLOT, in_slots, may_hold, sketch_of, sketch_rows, slot_of, write_clustered,
)
from usemeter.session import passing, stored
from usemeter.streaming import ranges

BASE = -1
SKETCH_BITS = 1 << 20  # of each level


class Levels(NamedTuple):
    """``folder`` holds rows with ``keys`` and whatever ``ddl`` names beside them.

    ``merge`` reduces the rows of several levels to those that still tell something.
    """

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    ddl: str
    merge: Callable[[DataFrame], DataFrame]
    fanout: int = 8
    group_bytes: int = 4 << 20

    def _write(self, rows: DataFrame, path: str) -> None:
        """A level's sketch, then its rows: the level counts once both are there."""
        name = path.rsplit("/", 1)[1]
        sketch_rows(rows, *self.keys, bits=SKETCH_BITS).write.mode("overwrite").parquet(f"{self.folder}/sketches/{name}")
        write_clustered(rows, path, self.keys, group_bytes=self.group_bytes)

    def _write_merged(self, rows: DataFrame, path: str) -> None:
        """A merge is worked out once, not for the sketch, the sample of ranges and the rows each."""
        with passing():
            self._write(stored(rows, "merged"), path)

    def _path(self, first: int, last: int) -> str:
        return f"{self.folder}/base/level" if first == BASE else ranges.part(f"{self.folder}/rows", first, last)

    def has_base(self) -> bool:
        return ranges.is_finished(self.spark, self._path(BASE, BASE))

    def write_base(self, rows: DataFrame) -> None:
        self._write(rows.select(*self._columns()), self._path(BASE, BASE))

    def _columns(self) -> list[str]:
        return [c.split()[0] for c in self.ddl.split(", ")]

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of one batch as a level, then the merge that the batch completes.

        ``rows`` is used twice: give a stored table.  A repeated batch writes the same level again.
        """
        self._write(rows.select(*self._columns()), self._path(batch_id, batch_id))
        ranges.merge_levels(
            self.spark, f"{self.folder}/rows", lambda r: self.merge(r.drop(SLOT)), batch_id, self.fanout,
            self._write_merged,
        )
        ranges.forget_others(self.spark, f"{self.folder}/sketches", f"{self.folder}/rows", batch_id)

    def open_levels(self, before: int | None = None) -> list[str]:
        """The folders that count, the base first; only batches ``before`` one."""
        base = [self._path(BASE, BASE)] if self.has_base() else []
        return base + [path for _, _, path in ranges.current(self.spark, f"{self.folder}/rows", before)]

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, {SLOT} int").parquet(path)

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of all levels with a key in ``wanted`` (distinct keys, a stored table).

        One small job tells which of the keys' slots each level may hold; levels with none are not read.
        """
        levels = self.open_levels(before)
        held = [self._may_hold(path) for path in levels]
        slots = wanted.groupBy(slot_of(*self.keys).alias(SLOT)).agg(
            *[F.bool_or(h).alias(f"in{i}") for i, h in enumerate(held)], F.count("*").alias("n")
        ).collect()  # at most SLOTS rows
        parts = []
        for i, path in enumerate(levels):
            here = sorted(r[SLOT] for r in slots if r[f"in{i}"])
            if here:
                parts.append(in_slots(self._read(path), here).drop(SLOT))
        if not parts:
            return self.spark.createDataFrame([], self.ddl)
        rows = reduce(DataFrame.unionByName, parts)
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(wanted[k]) for k in self.keys])
        return rows.join(wanted, same, "left_semi")

    def _may_hold(self, path: str):
        name = path.rsplit("/", 1)[1]
        rows = self.spark.read.schema("n bigint, words array<bigint>").parquet(f"{self.folder}/sketches/{name}")
        return may_hold(sketch_of(rows, SKETCH_BITS), *self.keys, bits=SKETCH_BITS)

    def all_rows(self) -> DataFrame:
        """Everything there is, not yet merged."""
        levels = self.open_levels()
        if not levels:
            return self.spark.createDataFrame([], self.ddl)
        return reduce(DataFrame.unionByName, [self._read(path).drop(SLOT) for path in levels])
