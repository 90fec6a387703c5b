"""Dense numbers in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usemeter.session import stored


def number_rows(df: DataFrame, order: str, name: str, start: Column | int = 0) -> DataFrame:
    """Adds ``name`` = start + 1, start + 2, ... by the unique column ``order``.

    Rows are dealt by ranges that hold about equally many of them (Spark samples the values, so
    clustered ones do no harm) and stored with their range, which fixes the ranges for both uses
    below.  They are numbered inside their range and shifted by the rows of the ranges before: a
    table with a row for each task, small enough for one window and one broadcast.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        df.repartitionByRange(tasks, order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        ranged.join(F.broadcast(shifts), "_range")
        .withColumn(name, (base + F.col("_shift") + inside).cast("bigint"))
        .drop("_range", "_shift")
    )
