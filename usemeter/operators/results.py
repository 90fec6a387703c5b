"""Submissions, verdicts and prose to result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.config import FIELDS, UsageSpec
from usemeter.functions import present
from usemeter.functions.repo import repo_key, repo_missing, repo_name
from usemeter.functions.text import blank_if_null, strip
from usemeter.operators.duplicates import append_note
from usemeter.operators.skew import lookup_join

PUBLIC_FIELDS = (
    "project", "github", "tag", "backbone", "description", "usage", "justification", "notes",
    "evidence", "seconds", "demo", "deployed", "names", "emails", "repo_accessible",
    "classify_failed", "score", "pipelines", "breakdown", "pipelines_called", "pipelines_total",
    "other_platforms", "explain_failed",
)


def route_expr(url: Column, status: Column, tree_status: Column, spec: UsageSpec) -> Column:
    """Where a submission goes.  A status never received counts as not 200."""
    ok = F.lit(200)
    return (
        F.when(repo_missing(url, spec), "no_repo")
        .when(repo_name(url, spec) == "", "unparseable")
        .when(~status.eqNullSafe(ok), "inaccessible")
        .when(~tree_status.eqNullSafe(ok), "incomplete")
        .otherwise("evaluate")
    )


def accessible_expr(route: Column) -> Column:
    """True, false, or null while the evidence is incomplete."""
    return F.when(route == "evaluate", True).when(route != "incomplete", False)


def route_notes(
    route: Column, status: Column, tree_status: Column, spec: UsageSpec
) -> tuple[Column, Column]:
    """(notes, justification) of a row that is not evaluated; null for the others."""
    shown = F.when(route == "unparseable", "?").otherwise(
        F.coalesce(status.cast("string"), F.lit("None"))
    )
    tree = F.format_string(
        spec.TREE_NOTE, F.coalesce(tree_status.cast("string"), F.lit("None"))
    )
    closed = route.isin("inaccessible", "unparseable")

    def pick(part: int) -> Column:
        texts = {r: t[part] for r, t in spec.route_texts.items()}
        incomplete = texts["incomplete"]
        return (
            F.when(route == "no_repo", texts["no_repo"])
            .when(closed, F.format_string(texts["inaccessible"], shown))
            .when(
                route == "incomplete",
                F.format_string(incomplete, tree) if "%s" in incomplete else F.lit(incomplete),
            )
        )

    return pick(0), pick(1)


def with_default_project(submissions: DataFrame, spec: UsageSpec) -> DataFrame:
    """Names a blank project after its repo."""
    name = F.nullif(repo_name(F.col("github"), spec), F.lit(""))
    given = F.when(strip(blank_if_null(F.col("project"))) != "", F.col("project"))
    return submissions.withColumn("project", F.coalesce(given, name, blank_if_null(F.col("project"))))


def attach_outcomes(
    submissions: DataFrame, outcomes: DataFrame, spec: UsageSpec
) -> DataFrame:
    """Submissions with what is known about their repo, evaluated once per distinct repo.

    ``outcomes`` has one row per ``repo_key`` with status, tree_status and the verdict columns.
    """
    keyed = submissions.withColumn(
        "repo_key",
        F.when(~repo_missing(F.col("github"), spec), repo_key(F.col("github"), spec)),
    )
    return lookup_join(keyed, outcomes, "repo_key", spread_by="ord")


def result_rows(
    submissions: DataFrame,
    outcomes: DataFrame,
    prose: DataFrame,
    duplicates: DataFrame,
    spec: UsageSpec,
) -> DataFrame:
    """One result per submission.

    The routes share one projection instead of a union of branches, so the join is made once.
    Texts about a repo are written before that join, once per repo.  Everything keyed by
    submission is joined first, while the rows are narrow; the wide verdicts come last and are
    not shuffled again.  ``prose(ord, description, usage, justification)`` and
    ``duplicates(ord, note)`` have at most one row per submission.
    """
    route = F.col("route")
    evaluated = route == "evaluate"
    described = outcomes.withColumns(
        {
            "_verdict": present.verdict_note(
                F.col("tag"), F.col("backbone"), F.col("score"), F.col("pipelines_called"),
                F.col("pipelines_total"),
            ),
            "_lines": present.evidence_lines(
                F.col("pipelines"), F.col("sdk"), F.col("other_platforms"), spec
            ),
        }
    )
    written = prose.select(
        "ord", F.col("description").alias("_description"), F.col("usage").alias("_usage"),
        F.col("justification").alias("_justification"), F.lit(True).alias("_written"),
    )
    notes_of = duplicates.select("ord", F.col("note").alias("_dup"))
    narrow = submissions.join(written, "ord", "left").join(notes_of, "ord", "left")
    rows = attach_outcomes(narrow, described, spec).withColumn(
        "route",
        route_expr(F.col("github"), F.col("status"), F.col("tree_status"), spec),
    )
    notes, reasons = route_notes(route, F.col("status"), F.col("tree_status"), spec)
    verdict, lines = F.col("_verdict"), F.col("_lines")
    missing = F.col("explain_failed")

    def when_evaluated(name: str, otherwise: Column) -> Column:
        return F.when(evaluated, F.col(name)).otherwise(otherwise)

    empty = F.array()
    seconds = F.col("seconds") if "seconds" in rows.columns else F.lit(0.0)
    types = dict(rows.dtypes)
    with_flags = rows.withColumn("explain_failed", evaluated & F.col("_written").isNull())
    return with_flags.select(
        "ord",
        *[blank_if_null(F.col(c)).alias(c) for c in FIELDS],
        "repo_key",
        "route",
        accessible_expr(route).alias("repo_accessible"),
        F.lit(False).alias("classify_failed"),
        "explain_failed",
        when_evaluated("tag", F.lit("None")).alias("tag"),
        when_evaluated("backbone", F.lit("No")).alias("backbone"),
        when_evaluated("score", F.lit(0.0)).alias("score"),
        when_evaluated("pipelines", empty.cast(types["pipelines"])).alias("pipelines"),
        F.when(evaluated, F.col("sdk")).alias("sdk"),
        when_evaluated("breakdown", empty.cast(types["breakdown"])).alias("breakdown"),
        when_evaluated("pipelines_called", F.lit(0)).alias("pipelines_called"),
        when_evaluated("pipelines_total", F.lit(0)).alias("pipelines_total"),
        when_evaluated("other_platforms", empty.cast("array<string>")).alias("other_platforms"),
        F.when(evaluated, blank_if_null(F.col("_description"))).otherwise("").alias("description"),
        F.when(evaluated, blank_if_null(F.col("_usage"))).otherwise("").alias("usage"),
        F.when(~evaluated, reasons)
        .when(missing, F.concat(verdict, F.lit(spec.PROSE_MISSING)))
        .otherwise(blank_if_null(F.col("_justification")))
        .alias("justification"),
        append_note(
            F.when(~evaluated, notes)
            .when(missing, F.concat(verdict, F.lit(spec.PROSE_PENDING)))
            .otherwise(verdict),
            F.col("_dup"),
        ).alias("notes"),
        F.when(evaluated, lines).otherwise(empty.cast("array<string>")).alias("evidence"),
        F.when(route == "no_repo", 0.0).otherwise(F.coalesce(seconds, F.lit(0.0))).alias("seconds"),
    )


def failed_rows(results: DataFrame) -> DataFrame:
    return results.where(present.is_failed(F.col("repo_accessible"), F.col("classify_failed")))


def sheet_rows(results: DataFrame, spec: UsageSpec) -> DataFrame:
    """The 14 sheet columns, preceded by the row order."""
    team = F.array_join(
        F.filter(
            F.array(blank_if_null(F.col("names")), blank_if_null(F.col("emails"))),
            lambda x: x != "",
        ),
        " / ",
    )
    total = F.col("pipelines_total")
    called = F.coalesce(F.col("pipelines_called").cast("string"), F.lit("None"))
    columns = {
        "project_name": blank_if_null(F.col("project")),
        "team_details": team,
        "description": blank_if_null(F.col("description")),
        "usage": blank_if_null(F.col("usage")),
        "usage_tag": blank_if_null(F.col("tag")),
        "backbone": blank_if_null(F.col("backbone")),
        "repo_link": blank_if_null(F.col("github")),
        "notes": blank_if_null(F.col("notes")),
        "justification": blank_if_null(F.col("justification")),
        "demo": blank_if_null(F.col("demo")),
        "deployed": blank_if_null(F.col("deployed")),
        "score": F.col("score"),
        "called_total": F.when(
            total.isNotNull(), F.concat(called, F.lit(" / "), total.cast("string"))
        ).otherwise(""),
        "evidence": F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), "\n"),
    }
    return results.select("ord", *[columns[c].alias(c) for c in spec.sheet_headers])


def explanation_requests(results: DataFrame, spec: UsageSpec) -> DataFrame:
    """What is sent out to be explained in prose, one row per evaluated submission."""
    feedback = blank_if_null(F.col("feedback"))
    return results.where(F.col("route") == "evaluate").select(
        "ord", "project", "github",
        F.when(feedback != "", feedback).otherwise("(none provided)").alias("feedback"),
        present.explanation_payload(spec).alias("payload"),
    )


def public_rows(results: DataFrame, spec: UsageSpec) -> DataFrame:
    """The fields a reader of the live stream sees, with the layer map."""
    given = F.col("layers") if "layers" in results.columns else None
    return results.select(
        "ord", *PUBLIC_FIELDS,
        present.layer_map(F.col("backbone"), spec, given).alias("layers"),
    ).withColumnRenamed("usage", f"{spec.product}_usage")
