"""Texts and maps shown to readers of the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.config import BACKBONE_COLOURS, LAYERS, TAG_COLOURS, UsageSpec
from usemeter.functions.text import blank_if_null, strip


def number_text(score: Column) -> Column:
    """One decimal, as the score is printed in notes (4.0, 3.5)."""
    return F.format_string("%.1f", score)


def verdict_note(tag, backbone, score, called, total) -> Column:
    return F.concat(
        F.lit("Deterministic score "), number_text(score), F.lit(" -> "), tag,
        F.lit(" / backbone "), backbone, F.lit("; "), called.cast("string"), F.lit("/"),
        total.cast("string"), F.lit(" pipeline(s) called."),
    )


def _site(s: Column) -> Column:
    return F.concat(s["file"], F.lit(":"), s["line"].cast("string"))


def evidence_lines(pipelines: Column, sdk: Column, platforms: Column, spec: UsageSpec) -> Column:
    """One line per definition, one for the SDK, one for other platforms if there are any."""

    def definition_line(p: Column) -> Column:
        where = F.array_join(
            F.transform(F.slice(p["call_sites"], 1, spec.caps.shown_sites), _site), "; "
        )
        status = (
            F.when(p["called"] & (where != ""), F.concat(F.lit("CALLED @ "), where))
            .when(p["called"], "CALLED")
            .otherwise("NOT called (present for show)")
        )
        return F.concat(
            p["name"], F.lit(" — "), p["nodes"].cast("string"), F.lit(" nodes ("),
            p["complexity"], F.lit("), "),
            F.when(p["has_agent"], "agent").otherwise("no agent"), F.lit(" — "), status,
        )

    return F.concat(
        F.transform(pipelines, definition_line),
        F.array(sdk_line(sdk["callsites"], sdk["file_spread"], sdk["hosted"])),
        F.when(
            F.size(platforms) > 0,
            F.array(F.concat(F.lit("Other platforms in code: "), F.array_join(platforms, ", "))),
        ).otherwise(F.array().cast("array<string>")),
    )


def sdk_line(callsites: Column, spread: Column, hosted: Column) -> Column:
    return F.concat(
        F.lit("SDK: "), callsites.cast("string"), F.lit(" call-site(s) across "),
        spread.cast("string"), F.lit(" file(s)"),
        F.when(hosted, ", hosted/Cloud usage").otherwise(""),
    )


def _colour(value: Column, colours: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in colours.items() for x in kv]
    return F.element_at(F.create_map(*pairs), value)


def tag_colour(tag: Column) -> Column:
    return _colour(tag, TAG_COLOURS)


def backbone_colour(backbone: Column) -> Column:
    return _colour(backbone, BACKBONE_COLOURS)


def layer_map(backbone: Column, spec: UsageSpec, given: Column | None = None) -> Column:
    """Layer -> who carries it.  Valid given values win over those the backbone implies."""
    verdict = F.lower(strip(blank_if_null(backbone)))
    product, other, none = F.lit(spec.product), F.lit("other"), F.lit("none")
    derived = {layer: none for layer in LAYERS}
    derived["orchestration"] = F.when(verdict.isin("yes", "partial"), product).otherwise(none)
    derived["reasoning"] = (
        F.when(verdict == "yes", product).when(verdict == "partial", other).otherwise(none)
    )
    if given is not None:
        for layer in LAYERS:
            value = F.lower(strip(F.element_at(given, layer)))
            derived[layer] = F.when(value.isin(spec.product, "other", "none"), value).otherwise(
                derived[layer]
            )
    return F.create_map(*[x for layer in LAYERS for x in (F.lit(layer), derived[layer])])


def evaluation_digest(pipelines: Column, spec: UsageSpec) -> Column:
    """First definitions with the three fields the progress panel shows."""
    return F.transform(
        F.slice(pipelines, 1, spec.caps.digest_definitions),
        lambda p: F.struct(p["name"], p["nodes"], p["called"]),
    )


def explanation_payload(spec: UsageSpec) -> Column:
    """The fixed verdict and its evidence as JSON, to be explained in prose elsewhere."""
    pipelines = F.transform(
        "pipelines",
        lambda p: F.struct(
            p["name"], p["nodes"], p["complexity"], p["has_agent"], p["called"],
            F.transform(p["call_sites"], _site).alias("call_sites"),
        ),
    )
    return F.to_json(
        F.struct(
            F.struct("tag", "backbone", "score").alias("verdict"),
            F.col("breakdown").alias("score_breakdown"),
            pipelines.alias("pipelines"),
            F.col("sdk"),
            F.col("other_platforms"),
        )
    )


def review_group(accessible: Column, classify_failed: Column, backbone: Column) -> Column:
    return F.when(is_failed(accessible, classify_failed), "review").otherwise(backbone)


def is_failed(accessible: Column, classify_failed: Column) -> Column:
    """Access is three-valued; only a plain true counts as accessed."""
    return ~accessible.eqNullSafe(F.lit(True)) | F.coalesce(classify_failed, F.lit(False))
