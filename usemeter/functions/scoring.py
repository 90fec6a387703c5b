"""The scoring rules as column expressions, shared by the nested and the flat form.

A rule is (condition, signal text, points).  The breakdown lists the rules that
fired and the score sums them, so the two always agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.text import same_struct_array

Rule = tuple[Column, Column, float]


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def dependency_rules(dependency: Column, spec: UsageSpec) -> list[Rule]:
    return [(dependency, _text("dependency in manifest"), spec.weights.dependency)]


def definition_rules(d: dict[str, Column], spec: UsageSpec) -> list[Rule]:
    """``d`` has name, nodes, has_agent, has_llm, tool_count and called, none of them null."""
    w, t = spec.weights, spec.thresholds
    called, nodes, name = d["called"], d["nodes"], d["name"]
    high = nodes >= t.high_nodes
    mid = (nodes >= t.mid_nodes) & ~high
    return [
        (called, _text("pipeline called: ", name), w.called),
        (called & d["has_agent"], _text("agent node in ", name), w.agent),
        (called & high, _text("complexity high (", nodes, " nodes)"), w.complexity_high),
        (called & mid, _text("complexity mid (", nodes, " nodes)"), w.complexity_mid),
        (
            called & (d["has_llm"] | (d["tool_count"] > 0)),
            _text("tool/llm node in ", name),
            w.tool_or_llm,
        ),
        (~called, _text("PENALTY pipeline never called: ", name), w.uncalled),
    ]


def sdk_rules(hosted: Column, callsites: Column, spread: Column, spec: UsageSpec) -> list[Rule]:
    w, t = spec.weights, spec.thresholds
    return [
        (hosted, _text("hosted-pipeline usage"), w.hosted),
        (callsites >= t.callsites, _text("SDK call-sites (", callsites, ")"), w.callsites),
        (spread >= t.spread, _text("SDK spread (", spread, " files)"), w.spread),
    ]


def fired(rules: list[Rule]) -> Column:
    return same_struct_array(
        [
            F.when(cond, F.struct(signal.alias("signal"), F.lit(float(pts)).alias("points")))
            for cond, signal, pts in rules
        ]
    )


def points(rules: list[Rule]) -> Column:
    terms = [F.when(cond, F.lit(float(pts))).otherwise(F.lit(0.0)) for cond, _, pts in rules]
    return reduce(lambda a, b: a + b, terms)


def final_score(total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(total, 1))


def raw_backbone(real: Column, competing: Column) -> Column:
    return F.when(~real, "No").when(competing, "Partial").otherwise("Yes")


def usage_tag(
    score: Column, backbone: Column, called: Column, blocked: Column, scaffold_only: Column,
    spec: UsageSpec,
) -> Column:
    """``blocked``: not accessible or overclaimed.  ``backbone`` is the raw one."""
    t = spec.thresholds
    return (
        F.when(blocked, "None")
        .when(scaffold_only & (called == 0), "Less")
        .when((score >= t.significant) & (backbone != "No"), "Significant")
        .when(score >= t.moderate, "Moderate")
        .when(score >= t.less, "Less")
        .otherwise("None")
    )


def coupled_backbone(tag: Column, backbone: Column) -> Column:
    """Weak or no usage cannot carry a project, whatever the raw backbone says."""
    return F.when(tag.isin("None", "Less"), "No").otherwise(backbone)
