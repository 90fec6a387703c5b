"""New results into a standing sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.repo import repo_key, repo_missing
from usemeter.functions.text import name_key
from usemeter.operators.numbering import number_rows
from usemeter.operators.skew import lookup_join
from usemeter.session import stored


def name_of_row(spec: UsageSpec) -> Column:
    """A sheet row's name key; null for unnamed rows, which no name finds."""
    named = F.col("project_name").isNotNull() & (F.col("project_name") != "")
    return F.when(named, name_key(F.col("project_name")))


def repo_of_row(spec: UsageSpec) -> Column:
    return F.when(~repo_missing(F.col("repo_link"), spec), repo_key(F.col("repo_link"), spec))


def match_keys(keyed: DataFrame, by_name: DataFrame, by_repo: DataFrame) -> DataFrame:
    """``keyed`` (``ord, _name, _repo``) with the columns of its owner: by name, otherwise by repo.

    ``by_name`` has ``_name, _by_name`` and more, ``by_repo`` ``_repo, _by_repo`` and more, a row a key.
    Both lookups tolerate hot keys.
    """
    named = lookup_join(keyed, by_name, "_name", spread_by="ord")
    # a row matched by name needs no second lookup and is spread like a row without a key
    open_rows = named.withColumn("_repo", F.when(F.col("_by_name").isNull(), F.col("_repo")))
    counts = (
        keyed.where(F.col("_repo").isNotNull()).groupBy("_repo").agg(F.count("*").alias("n"))
    )
    return lookup_join(open_rows, by_repo, "_repo", spread_by="ord", counts=counts)


def match_rows(sheet: DataFrame, new: DataFrame, spec: UsageSpec) -> DataFrame:
    """``ord, target``: the sheet row each new row replaces, or null for a row to append.

    A row is matched by name, otherwise by repo.  The later of two sheet rows owns a key.
    Unnamed sheet rows have no name key.  Both lookups take the largest row number per key, a
    partial aggregate.
    """
    keys = sheet.select("row_no", name_of_row(spec).alias("_name"), repo_of_row(spec).alias("_repo"))
    by_name, by_repo = (
        keys.where(F.col(k).isNotNull()).groupBy(k).agg(F.max("row_no").alias(f"_by{k}"))
        for k in ("_name", "_repo")
    )
    keyed = new.select(
        "ord", name_key(F.col("project_name")).alias("_name"), repo_of_row(spec).alias("_repo")
    )
    both = match_keys(keyed, by_name, by_repo)
    return both.select("ord", F.coalesce("_by_name", "_by_repo").alias("target"))


def place_rows(sheet: DataFrame, new: DataFrame, spec: UsageSpec) -> tuple[DataFrame, DataFrame]:
    """Two tables ``ord, row_no``: the rows that replace a sheet row, and the rows appended.

    The last of several results for one sheet row replaces it.  Appended rows are numbered in
    order behind the sheet, also when they share a name with each other.  The matches, two
    numbers per new row, are needed three times and therefore stored.
    """
    matched = stored(match_rows(sheet, new, spec), "matched")
    replacing = (
        matched.where(F.col("target").isNotNull())
        .groupBy(F.col("target").alias("row_no"))
        .agg(F.max("ord").alias("ord"))
    )
    top = F.coalesce(sheet.agg(F.max("row_no")).scalar(), F.lit(0))
    appended = number_rows(
        matched.where(F.col("target").isNull()).select("ord"), "ord", "row_no", top
    )
    return replacing.select("ord", "row_no"), appended.select("ord", "row_no")


def upsert(sheet: DataFrame, new: DataFrame, spec: UsageSpec) -> DataFrame:
    """The sheet after the upsert: ``row_no`` and the 14 columns.

    ``sheet`` has ``row_no``, ``new`` has the unique order ``ord``.  A matched row is replaced
    whole, blanks included.  Places are found on narrow rows; the wide new rows are joined once,
    by their unique order.
    """
    columns = list(spec.sheet_headers)
    replacing, appended = place_rows(sheet, new, spec)
    kept = sheet.join(replacing.select("row_no"), "row_no", "left_anti")
    placed = replacing.unionByName(appended).join(new, "ord")
    return kept.select("row_no", *columns).unionByName(placed.select("row_no", *columns))
