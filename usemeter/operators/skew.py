"""Lookups that stay even when one key holds a large share of the rows.

AQE splits a skewed join partition only if both join sides come straight from a
shuffle.  A lookup that is itself an aggregate does not, so hot keys are spread here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, key: str, n: str, tasks: int) -> DataFrame:
    """Keys with more rows than an even task has, and the ``salts`` that bring each down to that.

    Fewer than ``tasks`` keys can hold more than one part in ``tasks`` of all rows, so the result has
    fewer than ``tasks`` rows and may be broadcast.  It depends on the counts alone.
    """
    total = counts.agg(F.sum(n)).scalar()
    share = F.col(n) * tasks
    return counts.where(share > total).select(key, F.ceil(share / total).cast("int").alias("salts"))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str,
    counts: DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``rows`` with ``lookup``, which has one row per ``key``.

    Rows of hot keys are spread over salts taken from ``spread_by`` (a column with many values,
    so a retried task salts alike) and only the lookup rows of hot keys are repeated, all of them
    together fewer than two a task.  Rows without a key match nothing and are spread as well.
    ``counts`` (``key``, ``n``) saves the counting pass where the caller has it already.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(counts, key, "n", tasks).withColumnRenamed("salts", "_salts"))
    spread = F.when(F.col(key).isNull(), F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = rows.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), spread.cast("bigint")).cast("int")
    )
    right = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")
