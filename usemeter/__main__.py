"""The verification job: ``spark-submit usemeter/__main__.py`` or ``python -m usemeter``.

    python -m usemeter --product acme --title Acme --submissions SHEETS --snapshot DIR --out DIR
                       [--replies DIR] [--merge SHEET] [--limit N]

A full run writes the results, the sheet, the rows to correct and the summary.  With ``--merge``
the results go into an earlier sheet instead, and the merged sheet is written.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.operators import reports
from usemeter.operators.results import failed_rows, sheet_rows
from usemeter.operators.upsert import upsert
from usemeter.plans.verification import verify
from usemeter.session import build_session
from usemeter.sources import sinks
from usemeter.sources.sheets import load_submissions
from usemeter.sources.snapshots import REPLIES_DDL, read_replies, read_snapshot


def run(
    spark: SparkSession, spec: UsageSpec, submissions: str, snapshot: str, out: str,
    replies: str | None = None, merge: str | None = None, limit: int = 0,
) -> DataFrame:
    """Verifies all submissions and writes the outputs below ``out``; returns the summary."""
    rows = load_submissions(spark, submissions, spec, limit)
    given = read_replies(spark, replies) if replies else spark.createDataFrame([], REPLIES_DDL)
    verify(rows, read_snapshot(spark, snapshot), given, spec).write.parquet(f"{out}/results")
    results = spark.read.parquet(f"{out}/results")
    if merge:
        merged = upsert(spark.read.parquet(merge), sheet_rows(results, spec), spec)
        merged.write.parquet(f"{out}/sheet")
    else:
        sinks.write_sheet(results, f"{out}/sheet", spec)
        if not failed_rows(results).isEmpty():
            sinks.write_needs_review(results, f"{out}/needs_review")
    grouped = reports.with_review_group(results)
    summary = reports.verdict_counts(grouped, "tag", "backbone", "review_group")
    summary.write.parquet(f"{out}/summary")
    reports.timing(results).write.parquet(f"{out}/timing")
    return spark.read.parquet(f"{out}/summary")


def main() -> None:
    parser = argparse.ArgumentParser(prog="usemeter", description=__doc__.splitlines()[0])
    for name in ("product", "submissions", "snapshot", "out"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("title", "path-hint", "replies", "merge"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--limit", type=int, default=0)
    a = parser.parse_args()
    spec = UsageSpec.for_product(a.product, a.title, a.path_hint)
    spark = build_session("usemeter")
    summary = run(
        spark, spec, a.submissions, a.snapshot, a.out, a.replies, a.merge, a.limit
    )
    summary.orderBy("facet", F.desc("n")).show(truncate=False)


if __name__ == "__main__":
    main()
