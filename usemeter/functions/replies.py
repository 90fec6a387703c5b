"""JSON objects inside free-text replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.functions.binding import let
from usemeter.functions.definitions import is_single_json_value

PROSE_KEYS = ("description", "usage", "justification")
VERDICT_KEYS = ("tag", "repo_accessible")


def is_json_object(text: Column) -> Column:
    strict = F.from_json(
        text, "_corrupt string",
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return (
        F.json_object_keys(text).isNotNull()
        & strict["_corrupt"].isNull()
        & is_single_json_value(text)
    )


def simple_object(reply: Column) -> Column:
    """The fenced block if there is one, then everything from the first ``{`` to the last ``}``."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    span = F.regexp_extract(F.when(fenced != "", fenced).otherwise(reply), r"(?s)\{.*\}", 0)
    return F.when((span != "") & is_json_object(span), span)


def last_object(reply: Column, wanted: tuple[str, ...]) -> Column:
    """The last balanced top-level object that is JSON and has one of the wanted keys.

    The text is cut before every brace; a fold over the pieces keeps the depth, the
    piece where the open object began and the best object so far, so the whole reply
    is read once and only finished objects are put together again.
    """
    wanted_keys = F.array(*[F.lit(k) for k in wanted])

    def scan(pieces: Column) -> Column:
        marks = F.transform(
            pieces, lambda p, i: F.struct(i.alias("at"), F.left(p, F.lit(1)).alias("brace"))
        )

        def step(s: Column, m: Column) -> Column:
            opens = m["brace"] == "{"
            closes = (m["brace"] == "}") & (s["depth"] > 0)
            done = closes & (s["depth"] == 1)
            body = F.slice(pieces, s["start"] + 1, m["at"] - s["start"])
            found = let(
                F.concat(F.array_join(body, ""), F.lit("}")),
                lambda c: F.when(
                    F.arrays_overlap(F.json_object_keys(c), wanted_keys) & is_json_object(c), c
                ),
            )
            return F.struct(
                (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
                F.when(opens & (s["depth"] == 0), m["at"]).otherwise(s["start"]).alias("start"),
                F.when(done, F.coalesce(found, s["best"])).otherwise(s["best"]).alias("best"),
            )

        start = F.struct(
            F.lit(0).alias("depth"), F.lit(0).alias("start"),
            F.lit(None).cast("string").alias("best"),
        )
        return F.aggregate(marks, start, step, lambda s: s["best"])

    return let(F.split(reply, r"(?=[{}])"), scan)


def verdict_object(reply: Column) -> Column:
    """The last balanced object that looks like a verdict, otherwise the simple reading."""
    return F.coalesce(last_object(reply, VERDICT_KEYS), simple_object(reply))
