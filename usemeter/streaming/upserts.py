"""A standing sheet that takes in re-verified rows as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usemeter.config import UsageSpec
from usemeter.functions.text import name_key
from usemeter.operators.numbering import number_rows
from usemeter.operators.upsert import match_keys, name_of_row, repo_of_row
from usemeter.session import passing, stored
from usemeter.streaming import ranges
from usemeter.streaming.levels import Levels

#: A row had this key when the batch wrote the entry (``live``) or has it no longer; ``other`` is its
#: other key.  Kinds: ``name``, ``repo``, and ``top`` for the highest row number.
INDEX_DDL = "kind string, key string, row_no bigint, live boolean, other string, _batch bigint"


def last_forms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The last form of every row: ``row_no``, the columns, and the batch it came with."""
    last = rows.groupBy("row_no").agg(F.max_by(F.struct(*columns), "_batch").alias("_r"), F.max("_batch").alias("_batch"))
    return last.select("row_no", "_r.*", "_batch")


def current_sheet(spark: SparkSession, base: str, out: str, before: int | None = None) -> DataFrame:
    """The sheet after all finished batches (or those ``before`` one): each row's last form.

    ``base`` is the sheet that the stream began with; below ``out`` are changed and new rows by batch.
    """
    sheet = spark.read.parquet(base)
    columns = [c for c in sheet.columns if c != "row_no"]
    parts = ranges.current(spark, f"{out}/rows", before)
    if not parts:
        return sheet
    changes = spark.read.parquet(*[path for _, _, path in parts])
    rows = sheet.withColumn("_batch", F.lit(-1).cast("bigint")).unionByName(changes)
    return last_forms(rows, columns).select("row_no", *columns)


def _last_entries(entries: DataFrame) -> DataFrame:
    """What was said last of each (kind, key, row); rows that lost a key stay, to shadow older levels."""
    last = entries.groupBy("kind", "key", "row_no").agg(
        F.max_by(F.struct("live", "other"), "_batch").alias("e"), F.max("_batch").alias("_batch")
    )
    return last.select("kind", "key", "row_no", "e.live", "e.other", "_batch")


def key_index(spark: SparkSession, out: str, fanout: int) -> Levels:
    return Levels(spark, f"{out}/index", ("kind", "key"), INDEX_DDL, _last_entries, fanout)


def _entry(kind: str, key: Column, other: Column, live: bool) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), F.lit(live).alias("live"),
        other.cast("string").alias("other"),
    )


def _entries(placed: DataFrame, batch_id: int) -> DataFrame:
    """Entries of ``row_no, name, repo, old_name, old_repo``: the keys that rows have, and those they lost."""
    name, repo, old_name, old_repo = (F.col(c) for c in ("name", "repo", "old_name", "old_repo"))
    nothing = F.lit(None)
    entries = F.array(
        F.when(name.isNotNull(), _entry("name", name, repo, True)),
        F.when(repo.isNotNull(), _entry("repo", repo, name, True)),
        F.when(old_name.isNotNull() & ~old_name.eqNullSafe(name), _entry("name", old_name, nothing, False)),
        F.when(old_repo.isNotNull() & ~old_repo.eqNullSafe(repo), _entry("repo", old_repo, nothing, False)),
    )
    rows = placed.select("row_no", F.explode(F.array_compact(entries)).alias("e")).select("row_no", "e.*")
    top = placed.agg(F.max("row_no").alias("row_no")).where("row_no is not null").select(
        "row_no", F.lit("top").alias("kind"), F.lit("").alias("key"), F.lit(True).alias("live"),
        F.lit(None).cast("string").alias("other"),
    )
    return rows.unionByName(top).withColumn("_batch", F.lit(batch_id).cast("bigint"))


def index_sheet(index: Levels, sheet: DataFrame, spec: UsageSpec) -> None:
    """The base of the index: the keys of all rows of the sheet that the stream begins with."""
    none = F.lit(None).cast("string")
    keys = sheet.select(
        "row_no", name_of_row(spec).alias("name"), repo_of_row(spec).alias("repo"),
        none.alias("old_name"), none.alias("old_repo"),
    )
    with passing():
        index.write_base(stored(_entries(keys, -1), "base-index"))


def place_batch(index: Levels, batch: DataFrame, batch_id: int, spec: UsageSpec) -> DataFrame:
    """``ord, row_no`` with the keys that the row has from now on and those it had before.

    The batch meets the sheet as the batches before it left it, by name, otherwise by repo; the last of
    several results for one row replaces it, and rows without a match are numbered behind the sheet.
    Only the index entries of the batch's own keys are read.
    """
    name, repo = name_key(F.col("project_name")), repo_of_row(spec)
    keyed = stored(
        batch.select("ord", name.alias("_name"), repo.alias("_repo"), name_of_row(spec).alias("name"), repo.alias("repo")),
        "keyed",
    )
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    top = batch.sparkSession.range(1).select(F.lit("top").alias("kind"), F.lit("").alias("key"))
    asked = keyed.select(F.explode(F.array(pair("name", F.col("_name")), pair("repo", F.col("_repo")))).alias("k"))
    wanted = stored(asked.select("k.*").where("key is not null").unionByName(top).distinct(), "wanted")
    entries = _last_entries(index.lookup(wanted, before=batch_id)).where("live")
    owners = stored(
        entries.groupBy("kind", "key").agg(F.max(F.struct("row_no", "other")).alias("o")).select("kind", "key", "o.*"),
        "owners",
    )

    def owned(kind: str) -> DataFrame:
        return owners.where(F.col("kind") == kind).select(
            F.col("key").alias(f"_{kind}"), F.col("row_no").alias(f"_by_{kind}"), F.col("other").alias(f"_other_of_{kind}")
        )

    both = match_keys(keyed, owned("name"), owned("repo"))
    by_name = F.col("_by_name").isNotNull()
    matched = stored(
        both.select(
            "ord", "name", "repo", F.coalesce("_by_name", "_by_repo").alias("row_no"),
            F.when(by_name, F.col("_name")).otherwise(F.col("_other_of_repo")).alias("old_name"),
            F.when(by_name, F.col("_other_of_name")).when(F.col("_by_repo").isNotNull(), F.col("_repo")).alias("old_repo"),
        ),
        "matched",
    )
    last = F.max_by(F.struct("ord", "name", "repo", "old_name", "old_repo"), "ord").alias("r")
    replacing = matched.where("row_no is not null").groupBy("row_no").agg(last).select("row_no", "r.*")
    highest = owners.where("kind = 'top'").agg(F.max("row_no")).first()[0] or 0
    appended = number_rows(matched.where("row_no is null").drop("row_no"), "ord", "row_no", highest)
    return replacing.unionByName(appended)


def upsert_stream(
    spark: SparkSession, base: str, stream: DataFrame, out: str, checkpoint: str, spec: UsageSpec,
    fanout: int = 8,
) -> StreamingQuery:
    """Writes of every micro-batch only the rows that it changes or appends.

    A batch is matched with the sheet as the finished batches before it left it, by the sheet's key index:
    the sheet itself is not read again.  A folder without its success marker does not count, and a repeated
    batch writes the same rows again.  Changes and index are merged in levels.
    """
    columns = list(spec.sheet_headers)
    index = key_index(spark, out, fanout)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not index.has_base():
            index_sheet(index, spark.read.parquet(base), spec)
        with passing():
            placed = stored(place_batch(index, batch, batch_id, spec), "placed")
            changed = placed.select("ord", "row_no").join(batch, "ord").select("row_no", *columns)
            changed.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
                ranges.part(f"{out}/rows", batch_id, batch_id)
            )
            index.add(stored(_entries(placed, batch_id), "entries"), batch_id)
        ranges.merge_levels(spark, f"{out}/rows", lambda rows: last_forms(rows, columns), batch_id, fanout)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
