"""Pipeline-definition files: JSON text to metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.binding import let

_MEMBER_DDL = (
    "v struct<components: array<struct<provider: string>>, project_id: string>, _corrupt string"
)
METRICS_DDL = (
    "struct<nodes: int, providers: array<string>, has_agent: boolean, has_llm: boolean, "
    "tool_count: int, project_id: string>"
)


def is_single_json_value(text: Column) -> Column:
    """True when the text is one JSON value and nothing else.

    Spark's JSON functions stop reading behind the first value.  Read as the only
    element of an array and as the only member of an object, trailing text shows up.
    """
    as_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(
        (as_array == 1) & (as_member == F.array(F.lit("v"))), F.lit(False)
    )


def parse_definition(text: Column) -> Column:
    """Metrics struct of a definition file; null when the text is not a definition.

    The same two readings as in ``is_single_json_value``, the second one with the schema.
    """
    as_member = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")),
        _MEMBER_DDL,
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt"},
    )
    alone = F.rlike(text, F.lit(r"^\s*\{")) & (
        F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    )
    return F.when(
        alone,
        let(
            as_member,
            lambda d: F.when(
                d["_corrupt"].isNull(),
                definition_metrics(d["v"]["components"], d["v"]["project_id"]),
            ),
        ),
    )


def definition_metrics(components: Column, project_id: Column) -> Column:
    def starts(prefix):
        return lambda p: F.startswith(p, F.lit(prefix))

    def measured(providers: Column) -> Column:
        return F.struct(
            F.size(providers).alias("nodes"),
            providers.alias("providers"),
            F.exists(providers, starts("agent_")).alias("has_agent"),
            F.exists(providers, starts("llm_")).alias("has_llm"),
            F.size(F.filter(providers, starts("tool_"))).alias("tool_count"),
            F.coalesce(project_id, F.lit("")).alias("project_id"),
        ).cast(METRICS_DDL)

    providers = F.coalesce(
        F.transform(components, lambda c: F.coalesce(c["provider"], F.lit(""))),
        F.array().cast("array<string>"),
    )
    return let(providers, measured)


def complexity_band(nodes: Column, spec: UsageSpec) -> Column:
    t = spec.thresholds
    return (
        F.when(nodes >= t.high_nodes, "high").when(nodes >= t.mid_nodes, "medium").otherwise("low")
    )
