"""From stored tables to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.repo import repo_key, repo_missing
from usemeter.operators.duplicates import duplicate_notes
from usemeter.operators.evidence import gather
from usemeter.operators.replies import first_prose
from usemeter.operators.results import result_rows
from usemeter.operators.verdicts import evaluate
from usemeter.sources.snapshots import Snapshot, of_repos


def repo_outcomes(snapshot: Snapshot, spec: UsageSpec) -> DataFrame:
    """One row per repo: access status and verdict."""
    verdicts = evaluate(gather(*snapshot, spec), spec).drop("status")
    return snapshot.repos.select("repo_key", "status", "tree_status").join(verdicts, "repo_key")


def submitted_only(snapshot: Snapshot, submissions: DataFrame, spec: UsageSpec) -> Snapshot:
    """The part of a snapshot that the submissions name, whatever their number.

    Clustered tables are read in the row groups of these repos only; what else there is of trees and texts
    ends at the evidence's sketch of the open repos, before any text is looked at.
    """
    url = F.col("github")
    keys = (
        submissions.where(~repo_missing(url, spec))
        .select(repo_key(url, spec).alias("repo_key"))
        .distinct()
    )
    return of_repos(snapshot, keys)


def verify(
    submissions: DataFrame, snapshot: Snapshot, replies: DataFrame, spec: UsageSpec
) -> DataFrame:
    """Result rows of all submissions, with duplicate repos noted.

    Repos are evaluated once each, however many submissions name them, and only those.
    """
    prose = first_prose(replies, "ord", spec.caps.attempts, f"{spec.product}_usage")
    outcomes = repo_outcomes(submitted_only(snapshot, submissions, spec), spec)
    return result_rows(submissions, outcomes, prose, duplicate_notes(submissions, spec), spec)
