"""Counts, timings and comparisons of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.functions.present import review_group


def with_review_group(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "review_group",
        review_group(F.col("repo_accessible"), F.col("classify_failed"), F.col("backbone")),
    )


def verdict_counts(results: DataFrame, *facets: str) -> DataFrame:
    """``facet, value, n`` for each facet column, in one pass over the results."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.coalesce(f, F.lit("?")).alias("value"))
          for f in facets]
    )
    return results.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def timing(results: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Average, maximum and number of the non-zero timings."""
    return results.where(F.col(seconds) != 0).agg(
        F.avg(seconds).alias("avg_seconds"), F.max(seconds).alias("max_seconds"),
        F.count("*").alias("n"),
    )


def expected_diff(
    actual: DataFrame, expected: DataFrame, key: str, fields: tuple[str, ...]
) -> DataFrame:
    """One row per differing field: ``key, field, expected, actual``.

    Only fields the expectation names (not null) are compared.
    """
    wanted = expected.select(key, *[F.col(f).alias(f"_want_{f}") for f in fields])
    joined = wanted.join(actual.select(key, *fields), key, "left")
    diffs = [
        F.when(
            F.col(f"_want_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_want_{f}")),
            F.struct(
                F.lit(f).alias("field"), F.col(f"_want_{f}").cast("string").alias("expected"),
                F.col(f).cast("string").alias("actual"),
            ),
        )
        for f in fields
    ]
    return joined.select(key, F.inline(F.array_compact(F.array(*diffs))))


def case_tally(cases: DataFrame, diffs: DataFrame, key: str) -> DataFrame:
    """Passed and failed cases."""
    failed = diffs.select(key).distinct().withColumn("_failed", F.lit(True))
    return cases.select(key).join(failed, key, "left").agg(
        F.count_if(F.col("_failed").isNull()).alias("passed"),
        F.count_if(F.col("_failed").isNotNull()).alias("failed"),
    )


def drift(before: DataFrame, after: DataFrame, key: str, field: str = "tag") -> DataFrame:
    """Items whose verdict changed between two snapshots: ``key, before, after``."""
    joined = before.select(key, F.col(field).alias("before")).join(
        after.select(key, F.col(field).alias("after")), key
    )
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))
