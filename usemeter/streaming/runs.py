"""Progress events of verification runs.

Counts, latest states and progress are mergeable, so every micro-batch is reduced on its own
and written as partial rows; a reader merges the partials, and in levels they are merged in place.  No state is kept between batches: nothing grows with the number of items, late
events count, and a repeated batch overwrites its own folder.  A small, bounded count can instead run as a stateful aggregation
(``running_counts``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usemeter.functions.present import review_group
from usemeter.session import passing, stored
from usemeter.streaming import ranges
from usemeter.streaming.levels import Levels

EVENTS_DDL = (
    "run_id string, seq bigint, event string, idx int, total int, payload string, _broken string"
)


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """NDJSON events as they arrive.  A broken line becomes a row with only ``_broken`` set."""
    reader = spark.readStream.schema(EVENTS_DDL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )


def route_errors(events: DataFrame, error_text: str) -> DataFrame:
    """Failed items become error results and never stop the run.

    Adds ``is_result``, ``failed``, ``tag``, ``backbone``, ``notes`` and, for the review group,
    ``repo_accessible`` and ``classify_failed``.
    """
    failed = F.col("_broken").isNotNull() | (F.col("event") == "error")
    ended = F.coalesce(failed | (F.col("event") == "result"), F.lit(False))
    body = F.from_json("payload", "tag string, backbone string, notes string, repo_accessible boolean")
    return (
        events.withColumn("failed", F.coalesce(failed, F.lit(False)))
        .withColumn("is_result", ended)
        .withColumn("classify_failed", F.col("failed"))
        .withColumn("_b", body)
        .withColumn("repo_accessible", F.when(F.col("failed"), True).otherwise(F.col("_b.repo_accessible")))
        .withColumn("tag", F.when(failed, "None").when(ended, F.coalesce("_b.tag", F.lit("?"))))
        .withColumn(
            "backbone", F.when(failed, "No").when(ended, F.coalesce("_b.backbone", F.lit("?")))
        )
        .withColumn(
            "notes",
            F.when(
                failed,
                F.concat(F.lit(error_text), F.coalesce("_broken", "payload", F.lit(""))),
            ).otherwise(F.col("_b.notes")),
        )
        .drop("_b")
    )


def write_partials(
    stream: DataFrame, reduce_batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    merge: Callable[[DataFrame], DataFrame] | None = None, fanout: int = 8,
) -> StreamingQuery:
    """Reduces each micro-batch and writes it to its own folder below ``out``.

    With ``merge``, which reduces partials to partials, ``fanout`` folders of a level become one of the next.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce_batch(batch).write.mode("overwrite").parquet(ranges.part(out, batch_id, batch_id))
        if merge is not None:
            ranges.merge_levels(spark, out, merge, batch_id, fanout)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_partials(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(*[path for _, _, path in ranges.current(spark, out)])


# Each pair: the reduction of a batch, and the merge of the partials.


def count_batch(*keys: str, **conditions: Column) -> Callable[[DataFrame], DataFrame]:
    flags = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return lambda b: b.groupBy(*keys).agg(F.count("*").alias("n"), *flags)


def merge_counts(partials: DataFrame, *keys: str) -> DataFrame:
    sums = [c for c in partials.columns if c not in keys]
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def latest_batch(keys: tuple[str, ...], seq: str, *state: str) -> Callable[[DataFrame], DataFrame]:
    return lambda b: latest(b, keys, seq, *state)


def latest(rows: DataFrame, keys: tuple[str, ...], seq: str, *state: str) -> DataFrame:
    """The row with the highest ``seq`` per key; the same step merges partials."""
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct(seq, *state)).alias("_last"))
        .select(*keys, "_last.*")
    )


def progress_batch(key: str = "run_id") -> Callable[[DataFrame], DataFrame]:
    return lambda b: b.groupBy(key).agg(
        F.max("total").alias("total"), F.count_if("is_result").alias("results")
    )


def merge_progress(partials: DataFrame, key: str = "run_id") -> DataFrame:
    """X of N per run; a run is done once every item has ended.

    Counts events: for sources that deliver each once.  ``ended_items`` counts items.
    """
    return _with_done(
        partials.groupBy(key).agg(F.max("total").alias("total"), F.sum("results").alias("results"))
    )


def _with_done(progress: DataFrame) -> DataFrame:
    return progress.withColumn("done", F.coalesce(F.col("results") >= F.col("total"), F.lit(False)))


def ended_items(key: str = "run_id", item: str = "idx") -> Callable[[DataFrame], DataFrame]:
    """Per run the items that have ended, as bitmaps of 32,768 items each: an item ends once, however often
    its event comes.  Ended events without an item number (cut-off lines) are ``unnamed`` and counted."""
    number = F.col(item).cast("bigint") + 1
    ended = F.when(F.col("is_result"), F.bitmap_bit_position(number))
    return lambda b: b.groupBy(key, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.max("total").alias("total"), F.bitmap_construct_agg(ended).alias("ended"),
        F.count_if(F.col("is_result") & F.col(item).isNull()).alias("unnamed"),
    )


def merge_ended(partials: DataFrame, key: str = "run_id") -> DataFrame:
    """Partials to partials: the union of the bitmaps."""
    return partials.groupBy(key, "bucket").agg(
        F.max("total").alias("total"), F.bitmap_or_agg("ended").alias("ended"), F.sum("unnamed").alias("unnamed")
    )


def exact_progress(partials: DataFrame, key: str = "run_id") -> DataFrame:
    """X of N per run, X being distinct items: right also where events are delivered twice."""
    items = F.bitmap_count("ended") + F.col("unnamed")
    return _with_done(
        merge_ended(partials, key).groupBy(key).agg(F.max("total").alias("total"), F.sum(items).alias("results"))
    )


def running_counts(
    stream: DataFrame, keys: tuple[str, ...], out: str, checkpoint: str
) -> StreamingQuery:
    """Stateful counts for a small set of groups, the whole table after every batch.

    For keys from a fixed vocabulary (tag, backbone, review group) only: the state and each
    written table have one row per combination.
    """

    def write(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(ranges.part(out, 0, batch_id))

    return (
        stream.groupBy(*keys).agg(F.count("*").alias("n"))
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def last_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest finished version of the running counts; all but the last two are deleted."""
    return spark.read.parquet(ranges.newest(spark, out))


def facets(results: DataFrame) -> DataFrame:
    """One row per result and facet: ``facet, value`` for tag, backbone and review group."""
    group = review_group(F.col("repo_accessible"), F.col("classify_failed"), F.col("backbone"))
    pairs = {"tag": F.col("tag"), "backbone": F.col("backbone"), "review_group": group}
    ended = results.where("is_result") if "is_result" in results.columns else results
    return ended.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in pairs.items()])
        ).alias("f")
    ).select("f.facet", "f.value")


# --- counts that take back what they counted before ----------------------------------


def _last_states(keys: tuple[str, ...], seq: str, state: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: latest(rows, keys, seq, *state)


def latest_counts(
    spark: SparkSession, results: DataFrame, keys: tuple[str, ...], seq: str, state_ddl: str,
    facets_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fanout: int = 8,
) -> StreamingQuery:
    """Counts by facet of the latest result of every item: a new result takes its item's former one back.

    ``results`` has the ``keys`` of an item, the order ``seq`` (bigint) and the columns of ``state_ddl``;
    ``facets_of`` turns states into ``facet, value`` rows.  A batch looks up the former states of its own
    items only (``levels``), writes -1 for each that it replaces and +1 for the new one, and sets the new
    states.  Results that are not newer change nothing, so a late or repeated one does no harm.  Results
    without a complete key belong to no item: each counts for itself.
    """
    state = [c.split()[0] for c in state_ddl.split(", ")]
    types = dict(results.dtypes)
    ddl = ", ".join([f"{c} {types[c]}" for c in (*keys, seq)] + [state_ddl])
    last = _last_states(keys, seq, state)
    states = Levels(spark, f"{out}/states", keys, ddl, last, fanout)
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def write(batch: DataFrame, batch_id: int) -> None:
        with passing():
            new = stored(last(batch.where(named)), "new")
            old = last(states.lookup(stored(new.select(*keys), "asked"), before=batch_id))
            both = new.select(*keys, F.struct(seq, *state).alias("new")).join(
                old.select(*keys, F.struct(seq, *state).alias("old")), list(keys), "left"
            )
            newer = F.col("old").isNull() | (F.col(f"new.{seq}") > F.col(f"old.{seq}"))
            moved = stored(both.where(newer), "moved")
            counted = moved.select("new.*").select(*state).unionByName(batch.where(~named).select(*state))
            taken = moved.where("old is not null").select("old.*").select(*state)
            changes = facets_of(counted).withColumn("n", F.lit(1).cast("bigint")).unionByName(
                facets_of(taken).withColumn("n", F.lit(-1).cast("bigint"))
            )
            merge_counts(changes, "facet", "value").write.mode("overwrite").parquet(
                ranges.part(f"{out}/counts", batch_id, batch_id)
            )
            states.add(moved.select(*keys, "new.*"), batch_id)
        ranges.merge_levels(
            spark, f"{out}/counts", lambda p: merge_counts(p, "facet", "value"), batch_id, fanout
        )

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """``facet, value, n`` after all finished batches; values that no item has any more are left out."""
    return merge_counts(read_partials(spark, f"{out}/counts"), "facet", "value").where("n <> 0")
