"""Free-text replies to prose, one row per asked item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.functions.replies import PROSE_KEYS, last_object


def first_prose(replies: DataFrame, key: str, attempts: int | None, *usage_keys: str) -> DataFrame:
    """``key, description, usage, justification`` of the first attempt with a usable object.

    ``replies(key, attempt, reply)``; attempts count from 1, and all count unless ``attempts`` says how
    many.  ``usage_keys`` are further names under which a reply may carry the usage text.  The reply is reduced to the three texts
    before the shuffle.
    """
    usage_names = ("usage", *usage_keys)
    wanted = (PROSE_KEYS[0], *usage_names, PROSE_KEYS[2])
    fields = ", ".join(f"{k} string" for k in wanted)
    counting = replies if attempts is None else replies.where(F.col("attempt") <= attempts)
    found = (
        counting
        # Exploded, not filtered: a filter would look for the object a second time.
        .select(key, "attempt", F.explode(F.array_compact(F.array(last_object(F.col("reply"), wanted)))).alias("_object"))
        .withColumn("_o", F.from_json("_object", fields, {"allowSingleQuotes": "false"}))
    )

    def text(*names: str):
        return F.coalesce(*[F.col(f"_o.{n}") for n in names], F.lit(""))

    texts = F.struct(
        text("description").alias("description"), text(*usage_names).alias("usage"),
        text("justification").alias("justification"),
    )
    return (
        found.groupBy(key)
        .agg(F.min_by(texts, "attempt").alias("_p"))
        .select(key, "_p.description", "_p.usage", "_p.justification")
    )
