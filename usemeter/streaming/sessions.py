"""Listening sessions that begin with their first event.

A session of a key opens with the first event that belongs to no earlier one and lasts a fixed time; what
it tallied is emitted once the watermark has passed its end.  Events may come in any order until then: the
sessions follow from the events' times alone, so the stream gives what a batch over the same events gives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from usemeter.config import MONITOR_SECONDS, UsageSpec
from usemeter.streaming.monitor import has_verdict

SESSIONS_DDL = "key string, session_start timestamp, event string, n bigint, verdicts bigint, late boolean"

#: Timers and maps of :class:`_Sessions` need it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _row(key: str, start: int | None, event: str | None, n: int, verdicts: int, late: bool) -> Row:
    at = None if start is None else datetime.fromtimestamp(start / 1000, timezone.utc).replace(tzinfo=None)
    return Row(key=key, session_start=at, event=event, n=n, verdicts=verdicts, late=late)


class _Sessions(StatefulProcessor):
    """Per key: events not yet emitted, counted by (millisecond, type), and the end of the last session."""

    def __init__(self, millis: int) -> None:
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts bigint, event string", "n bigint, verdicts bigint")
        self.closed = handle.getValueState("closed", "upto bigint")

    def _closed_upto(self) -> int | None:
        return self.closed.get()[0] if self.closed.exists() else None

    def _first(self) -> int | None:
        return min((ts for ts, _ in self.waiting.keys()), default=None)

    def _set_timer(self) -> None:
        first = self._first()
        wanted = None if first is None else first + self.millis
        for timer in list(self.handle.listTimers()):
            if timer != wanted:
                self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, late, closed = Counter(), Counter(), self._closed_upto()
        for r in rows:
            counts = late if closed is not None and r.ts < closed else new
            counts[r.ts, r.event] += r.n
            counts[r.ts, r.event, "verdicts"] += r.verdicts
        for at in [k for k in new if len(k) == 2]:
            n, verdicts = self.waiting.getValue(at) if self.waiting.containsKey(at) else (0, 0)
            self.waiting.updateValue(at, (n + new[at], verdicts + new[(*at, "verdicts")]))
        for at in sorted((k for k in late if len(k) == 2), key=str):
            yield _row(key[0], None, at[1], late[at], late[(*at, "verdicts")], True)
        if new:  # an event from before the watermark may open a session that is over already
            yield from self._close_sessions(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._close_sessions(key[0], timerValues.getCurrentWatermarkInMs())

    def _close_sessions(self, key: str, now: int) -> Iterator[Row]:
        """Emits the sessions that end by ``now``; the timer is set to the end of the next one."""
        while (first := self._first()) is not None and first + self.millis <= now:
            n, verdicts = Counter(), Counter()
            for (ts, event), (count, with_verdict) in list(self.waiting.iterator()):
                if ts < first + self.millis:
                    n[event] += count
                    verdicts[event] += with_verdict
                    self.waiting.removeKey((ts, event))
            self.closed.update((first + self.millis,))
            for event in sorted(n, key=str):
                yield _row(key, first, event, n[event], verdicts[event], False)
        self._set_timer()

    def close(self) -> None:
        pass


def listening_sessions(
    events: DataFrame, spec: UsageSpec, key: str, late: str, seconds: int = MONITOR_SECONDS
) -> DataFrame:
    """A stream of ``key, session_start, event, n, verdicts, late`` from ``ts, event, body`` and ``key``.

    A row per session and event type once the watermark, ``late`` behind the newest event, is past its end.
    Events whose session was emitted already come out as rows with ``late`` and without a start: nothing is
    lost in silence.  Times count in milliseconds.  The state holds what is not yet emitted; needs the
    state store of ``STATE_STORE``.
    """
    counted = events.select(
        F.col(key).cast("string").alias("key"), "ts", "event",
        has_verdict(F.col("body"), spec).cast("bigint").alias("verdicts"),
    ).withWatermark("ts", late)
    # Without the event-time column itself, so that Spark drops no late row before it can be told.
    rows = counted.select("key", F.unix_millis("ts").alias("ts"), "event", F.lit(1).cast("bigint").alias("n"), "verdicts")
    return rows.groupBy("key").transformWithState(_Sessions(seconds * 1000), SESSIONS_DDL, "append", "eventTime")
