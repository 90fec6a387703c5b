"""Submissions that share a repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.repo import repo_key, repo_missing
from usemeter.functions.text import blank_if_null
from usemeter.operators.skew import lookup_join


def duplicate_members(results: DataFrame, spec: UsageSpec) -> DataFrame:
    """Every row of every group with more than one row: ``ord, project, repo_key, n``.

    Linear in the input whatever the group sizes: groups are counted with map-side partial
    counts and the count is looked up per row, so no group is gathered in one place.
    """
    rows = results.where(~repo_missing(F.col("github"), spec)).select(
        "ord", F.coalesce("project", F.lit("?")).alias("project"),
        repo_key(F.col("github"), spec).alias("repo_key"),
    )
    sizes = rows.groupBy("repo_key").agg(F.count("*").alias("n"))
    return lookup_join(
        rows, sizes.where("n > 1"), "repo_key", spread_by="ord", counts=sizes, how="inner"
    )


def duplicate_notes(results: DataFrame, spec: UsageSpec) -> DataFrame:
    """``ord, repo_key, n, note`` for every row of a group with more than one row.

    The note names the group and its size, in one form for groups of any size; who is in the group
    stands once in ``duplicate_members``.  Listing all others on every row would be quadratic.
    """
    note = F.concat(
        F.lit("duplicate repo ("), F.col("n").cast("string"), F.lit(" rows share "),
        F.col("repo_key"), F.lit(")"),
    )
    return duplicate_members(results, spec).select("ord", "repo_key", "n", note.alias("note"))


def append_note(notes: Column, duplicate: Column) -> Column:
    """The duplicate note behind the row's own notes; a null note changes nothing."""
    text = F.btrim(F.concat(blank_if_null(notes), F.lit("; "), duplicate), F.lit("; "))
    return F.when(duplicate.isNotNull(), text).otherwise(notes)


def mark_duplicates(results: DataFrame, spec: UsageSpec) -> DataFrame:
    """Result rows with the duplicate note added."""
    notes = duplicate_notes(results, spec).select("ord", F.col("note").alias("_dup"))
    return (
        results.join(notes, "ord", "left")
        .withColumn("notes", append_note(F.col("notes"), F.col("_dup")))
        .drop("_dup")
    )
