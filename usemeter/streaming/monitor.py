"""Event monitor: tallies per event type and listening window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.config import MONITOR_SECONDS, UsageSpec
from usemeter.functions.text import blank_if_null, contains_any


def has_verdict(body: Column, spec: UsageSpec) -> Column:
    return contains_any(blank_if_null(body), spec.verdict_markers)


def tally(events: DataFrame, spec: UsageSpec, *keys: str) -> DataFrame:
    """Events per type, and how many of them carry a verdict.  Batch or stream."""
    return events.groupBy(*(keys or ("event",))).agg(
        F.count("*").alias("n"), F.count_if(has_verdict(F.col("body"), spec)).alias("verdicts")
    )


def windowed(events: DataFrame, seconds: int = MONITOR_SECONDS) -> DataFrame:
    """Adds the start of the listening window an event falls into."""
    return events.withColumn("window_start", F.window("ts", f"{seconds} seconds")["start"])


def window_tally_stream(events: DataFrame, spec: UsageSpec, late: str) -> DataFrame:
    """The tally per window as a stateful stream.

    The watermark closes windows ``late`` behind the newest event, which bounds the state;
    events later than that are not counted.  Where every event must count, use the partials
    of :mod:`usemeter.streaming.runs` with :func:`windowed`.
    """
    span = F.window("ts", f"{MONITOR_SECONDS} seconds")
    return (
        events.withWatermark("ts", late)
        .groupBy(span, "event")
        .agg(F.count("*").alias("n"), F.count_if(has_verdict(F.col("body"), spec)).alias("verdicts"))
        .select(F.col("window.start").alias("window_start"), "event", "n", "verdicts")
    )
