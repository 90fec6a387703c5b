"""Evidence to verdict, in a nested and in a flat form that share their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions import scoring
from usemeter.functions.definitions import complexity_band

EVALUATED = (
    "tag", "backbone", "score", "pipelines", "sdk", "breakdown", "pipelines_called",
    "pipelines_total", "other_platforms",
)


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


# --- nested: one evidence row in, one verdict row out, no shuffle -----------------


def _pipeline(p: Column, spec: UsageSpec) -> Column:
    m = p["metrics"]
    nodes = F.coalesce(m["nodes"], F.lit(0))
    return F.struct(
        p["path"].alias("name"),
        nodes.alias("nodes"),
        complexity_band(nodes, spec).alias("complexity"),
        _false_if_null(m["has_agent"]).alias("has_agent"),
        _false_if_null(m["has_llm"]).alias("has_llm"),
        F.coalesce(m["tool_count"], F.lit(0)).alias("tool_count"),
        F.coalesce(m["providers"], F.array().cast("array<string>")).alias("providers"),
        _false_if_null(p["called"]).alias("called"),
        F.coalesce(
            p["call_sites"],
            F.array().cast("array<struct<file: string, line: int, snippet: string>>"),
        ).alias("call_sites"),
    )


def _rules_of(p: Column, spec: UsageSpec) -> list[scoring.Rule]:
    parts = ("name", "nodes", "has_agent", "has_llm", "tool_count", "called")
    return scoring.definition_rules({k: p[k] for k in parts}, spec)


def evaluate(evidence: DataFrame, spec: UsageSpec) -> DataFrame:
    """Adds the verdict columns to evidence rows; other columns pass through."""
    sdk = F.col("sdk")
    other = [c for c in evidence.columns if c not in (*EVALUATED, "pipes")]
    accessible = _optional(evidence, "accessible", F.lit(False))
    blocked = ~accessible | _optional(evidence, "overclaim", F.lit(False))
    measured = evidence.select(
        *other,
        F.coalesce("other_platforms", F.array().cast("array<string>")).alias("other_platforms"),
        F.struct(
            F.coalesce(sdk["callsites"], F.lit(0)).alias("callsites"),
            F.coalesce(sdk["file_spread"], F.lit(0)).alias("file_spread"),
            _false_if_null(sdk["hosted"]).alias("hosted"),
            _false_if_null(sdk["engine"]).alias("engine"),
        ).alias("sdk"),
        F.when(
            accessible, F.transform("pipes", lambda p: _pipeline(p, spec))
        ).alias("pipelines"),
        accessible.alias("_accessible"),
        blocked.alias("_blocked"),
        _optional(evidence, "scaffold_only", F.lit(False)).alias("_scaffold"),
        _optional(evidence, "dependency", F.lit(False)).alias("_dependency"),
    ).withColumn(
        "pipelines",
        F.coalesce("pipelines", F.array().cast(evidence_pipelines_type())),
    )
    breakdown = F.concat(
        scoring.fired(scoring.dependency_rules(F.col("_dependency"), spec)),
        F.flatten(F.transform("pipelines", lambda p: scoring.fired(_rules_of(p, spec)))),
        scoring.fired(
            scoring.sdk_rules(sdk["hosted"], sdk["callsites"], sdk["file_spread"], spec)
        ),
    )
    empty = F.array().cast("array<struct<signal: string, points: double>>")
    called = F.size(F.filter("pipelines", lambda p: p["called"]))
    runs = F.exists("pipelines", lambda p: p["called"] & (p["has_agent"] | p["has_llm"]))
    competitors = F.array(*[F.lit(c) for c in spec.competitors])
    scored = (
        measured.withColumn("breakdown", F.when(F.col("_accessible"), breakdown).otherwise(empty))
        .withColumn(
            "score",
            scoring.final_score(
                F.aggregate("breakdown", F.lit(0.0), lambda acc, b: acc + b["points"])
            ),
        )
        .withColumn("pipelines_called", called)
        .withColumn("pipelines_total", F.size("pipelines"))
        .withColumn(
            "_raw",
            scoring.raw_backbone(
                F.col("_accessible") & (runs | sdk["hosted"] | sdk["engine"]),
                F.arrays_overlap("other_platforms", competitors),
            ),
        )
    )
    return _decide(scored, spec).select(
        *[c for c in other if not c.startswith("_")], *EVALUATED
    )


def evidence_pipelines_type() -> str:
    return (
        "array<struct<name: string, nodes: int, complexity: string, has_agent: boolean, "
        "has_llm: boolean, tool_count: int, providers: array<string>, called: boolean, "
        "call_sites: array<struct<file: string, line: int, snippet: string>>>>"
    )


def _decide(scored: DataFrame, spec: UsageSpec) -> DataFrame:
    """Tag from the raw backbone first, then the backbone from the tag."""
    tag = scoring.usage_tag(
        F.col("score"), F.col("_raw"), F.col("pipelines_called"), F.col("_blocked"),
        F.col("_scaffold"), spec,
    )
    return scored.withColumn("tag", tag).withColumn(
        "backbone", scoring.coupled_backbone(F.col("tag"), F.col("_raw"))
    )


# --- flat: definitions and repo facts as long tables ------------------------------


def _flat_rules(spec: UsageSpec) -> list[scoring.Rule]:
    parts = ("name", "nodes", "has_agent", "has_llm", "tool_count", "called")
    return scoring.definition_rules({k: F.col(k) for k in parts}, spec)


def score_repos(facts: DataFrame, definitions: DataFrame, spec: UsageSpec) -> DataFrame:
    """Verdict per repo without a cap on definitions.

    ``facts(repo_key, dependency, callsites, file_spread, hosted, engine, competing, blocked,
    scaffold_only)`` and ``definitions(repo_key, name, nodes, has_agent, has_llm, tool_count,
    called)``.  Definitions are reduced to points before the shuffle, so a repo with any
    number of them sends one row per task.
    """
    rolled = definitions.groupBy("repo_key").agg(
        F.sum(scoring.points(_flat_rules(spec))).alias("_points"),
        F.count_if("called").alias("_called"),
        F.count("*").alias("_total"),
        F.bool_or(F.col("called") & (F.col("has_agent") | F.col("has_llm"))).alias("_runs"),
    )
    repo_points = scoring.points(
        scoring.dependency_rules(F.col("dependency"), spec)
        + scoring.sdk_rules(F.col("hosted"), F.col("callsites"), F.col("file_spread"), spec)
    )
    real = _false_if_null(F.col("_runs")) | F.col("hosted") | F.col("engine")
    scored = (
        facts.join(rolled, "repo_key", "left")
        .withColumn("pipelines_called", F.coalesce("_called", F.lit(0)).cast("bigint"))
        .withColumn("pipelines_total", F.coalesce("_total", F.lit(0)).cast("bigint"))
        .withColumn("score", scoring.final_score(repo_points + F.coalesce("_points", F.lit(0.0))))
        .withColumn("_raw", scoring.raw_backbone(real, F.col("competing")))
        .withColumn("_blocked", F.col("blocked"))
        .withColumn("_scaffold", F.col("scaffold_only"))
    )
    return _decide(scored, spec).drop(
        "_points", "_called", "_total", "_runs", "_raw", "_blocked", "_scaffold"
    )


def breakdown_rows(facts: DataFrame, definitions: DataFrame, spec: UsageSpec) -> DataFrame:
    """One row per point given: ``repo_key, part, name, signal, points``, nothing collected."""

    def long(df: DataFrame, part: int, name: Column, rules: list[scoring.Rule]) -> DataFrame:
        return df.select(
            "repo_key", F.lit(part).alias("part"), name.alias("name"),
            F.inline(scoring.fired(rules)),
        )

    nothing = F.lit("")
    sdk = scoring.sdk_rules(F.col("hosted"), F.col("callsites"), F.col("file_spread"), spec)
    return (
        long(facts, 0, nothing, scoring.dependency_rules(F.col("dependency"), spec))
        .unionByName(long(definitions, 1, F.col("name"), _flat_rules(spec)))
        .unionByName(long(facts, 2, nothing, sdk))
    )
