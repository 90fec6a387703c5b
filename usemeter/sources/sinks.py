"""Where results go.  Every sink writes in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.config import NEEDS_REVIEW_HEADERS, UsageSpec
from usemeter.operators.numbering import number_rows
from usemeter.operators.results import failed_rows, public_rows, sheet_rows


def write_sheet(results: DataFrame, path: str, spec: UsageSpec, form: str = "parquet") -> None:
    """The 14-column sheet: Parquet with the row number as a column, CSV with printed headers.

    Only the CSV is sorted, as nothing else in it tells the order.
    """
    rows = sheet_rows(results, spec)
    if form == "parquet":
        numbers = number_rows(results.select("ord"), "ord", "row_no")
        numbers.join(rows, "ord").select("row_no", *spec.sheet_headers).write.parquet(path)
        return
    rows.orderBy("ord").select(*[F.col(c).alias(h) for c, h in spec.sheet_headers.items()]).write.csv(
        path, header=True, quote='"', escape='"'
    )


def write_needs_review(results: DataFrame, path: str) -> None:
    """Rows that failed the access check, as CSV that spreadsheet programs open as UTF-8."""
    names = list(NEEDS_REVIEW_HEADERS.items())
    marked = [
        F.col(c).alias(("﻿" if i == 0 else "") + h) for i, (c, h) in enumerate(names)
    ]
    failed_rows(results).orderBy("ord").select(*marked).write.csv(
        path, header=True, quote='"', escape='"', emptyValue=""
    )


def write_ndjson(results: DataFrame, path: str, spec: UsageSpec, compression: str = "none") -> None:
    """Public fields, one JSON object per line, nulls kept, in no particular order.

    Submissions of one repo repeat its definitions and evidence: with ``compression="gzip"`` files of many
    submissions are a small part of the plain text.
    """
    public_rows(results, spec).drop("ord").write.option(
        "ignoreNullFields", "false"
    ).json(path, compression=compression)


def write_replies(replies: DataFrame, path: str) -> None:
    """Replies under the row keys of the submissions that they answer: ``ord, attempt, reply``."""
    replies.select(F.col("ord").cast("string"), F.col("attempt").cast("int"), "reply").write.parquet(path)
