"""Stored snapshots of repos, and captured evidence cases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from usemeter.operators.clustering import GROUP_BYTES, SLOT, in_slots, wanted_slots, write_clustered

SCANS = 32  # of one snapshot table, each over the row groups of 512 slots

REPOS_DDL = (
    "repo_key string, status int, tree_status int, default_branch string, tree_truncated boolean"
)
TREE_DDL = "repo_key string, tree_ord bigint, path string"
FILES_DDL = "repo_key string, path string, text string"
REPLIES_DDL = "ord string, attempt int, reply string"

CASE_DDL = """
name string,
evidence struct<
  accessible: boolean, dependency: boolean, scaffold_only: boolean, overclaim: boolean,
  other_platforms: array<string>,
  sdk: struct<callsites: int, file_spread: int, hosted: boolean, engine: boolean>,
  pipes: array<struct<
    path: string,
    metrics: struct<nodes: int, providers: array<string>, has_agent: boolean, has_llm: boolean,
                    tool_count: int, project_id: string>,
    called: boolean,
    call_sites: array<struct<file: string, line: int, snippet: string>>>>>,
expect struct<tag: string, backbone: string, score: double>
"""


class Snapshot(NamedTuple):
    repos: DataFrame
    tree: DataFrame
    files: DataFrame


def write_snapshot(
    snapshot: Snapshot, path: str, files: int | None = None, group_bytes: int = GROUP_BYTES
) -> None:
    """The three tables below ``path``, clustered by repo: a few repos are read from a few row groups.

    The texts of a repo lie side by side; a repo that holds much of the corpus is dealt over files by path.
    """
    for name, spread_by in (("repos", ()), ("repo_tree", ("tree_ord", "path")), ("repo_files", ("path",))):
        table = snapshot[("repos", "repo_tree", "repo_files").index(name)]
        write_clustered(table, f"{path}/{name}", ("repo_key",), spread_by, files, group_bytes)


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The three snapshot tables below ``path``: Parquet folders, any partitioning, clustered or not."""

    def table(name: str, ddl: str) -> DataFrame:
        clustered = SLOT in spark.read.parquet(f"{path}/{name}").columns
        return spark.read.schema(f"{ddl}, {SLOT} int" if clustered else ddl).parquet(f"{path}/{name}")

    return Snapshot(
        table("repos", REPOS_DDL), table("repo_tree", TREE_DDL), table("repo_files", FILES_DDL)
    )


def of_repos(snapshot: Snapshot, keys: DataFrame) -> Snapshot:
    """What a snapshot has of the repos in ``keys`` (distinct ``repo_key``).

    Of clustered tables only the row groups with a slot of ``keys`` are read, which takes one small job
    here for the slots.  The repo table is exact; trees and texts still hold repos that share a slot.
    """
    repos = snapshot.repos.join(keys, "repo_key", "left_semi")
    if not any(SLOT in df.columns for df in snapshot):
        return snapshot._replace(repos=repos)
    slots = wanted_slots(keys, "repo_key")
    tree, files = (in_slots(df, slots, SCANS) for df in (snapshot.tree, snapshot.files))
    return Snapshot(in_slots(repos, slots), tree, files)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPLIES_DDL).parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Captured evidence with the expected verdict, one JSON object per file, in order of the files."""
    return (
        spark.read.schema(CASE_DDL)
        .json(path, multiLine=True)
        .selectExpr("_metadata.file_name AS file_name", "name", "evidence.*", "expect")
        .orderBy("file_name")
    )
