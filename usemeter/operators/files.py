"""File trees and file texts: which files count, and what each text says.

Texts are the bulk of the data.  Each text is reduced to a few signals inside its scan
task, and files without any signal stop there; what leaves a task of a line is its number,
a snippet, and the definitions that it names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.binding import let
from usemeter.functions.definitions import METRICS_DDL, parse_definition
from usemeter.functions.dictionary import words_of
from usemeter.functions.text import contains_any, lines, strip
from usemeter.operators.clustering import may_hold, sketch, sketch_bits

NAME_BITS = 1 << 25  # of the sketch of all repos' definition names, at most


def path_kind(path: Column, spec: UsageSpec) -> Column:
    return (
        F.when(F.endswith(path, F.lit(spec.definition_suffix)), "definition")
        .when(F.rlike(path, F.lit(spec.manifest_regex)), "manifest")
        .when(F.rlike(path, F.lit(spec.source_regex)), "source")
    )


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def tree_facts(tree: DataFrame, spec: UsageSpec) -> DataFrame:
    """Per repo: number of paths, scaffold rule present, definitions folder present."""
    folder = spec.definitions_folder
    path = F.col("path")
    return tree.groupBy("repo_key").agg(
        F.count("*").cast("int").alias("file_count"),
        F.bool_or(F.endswith(path, F.lit(spec.scaffold_suffix))).alias("has_scaffold"),
        F.bool_or((path == folder) | F.contains(path, F.lit(f"{folder}/"))).alias(
            "definitions_folder"
        ),
    )


def ordered_files(tree: DataFrame, spec: UsageSpec, hint_regex: str | None = None) -> DataFrame:
    """All classified files with their place among the files of their kind: hinted sources first.

    ``repo_key, path, kind, place``; the place is a struct to be compared, not a number, so no
    repo's files are gathered to be counted off.
    """
    kind = path_kind(F.col("path"), spec)
    hinted = (F.col("kind") == "source") & F.rlike("path", F.lit(hint_regex or spec.hint_regex))
    return (
        tree.select("repo_key", "path", "tree_ord", kind.alias("kind"))
        .where(F.col("kind").isNotNull())
        .select(
            "repo_key", "path", "kind",
            F.struct((~hinted).alias("unhinted"), "tree_ord", "path").alias("place"),
        )
    )


def select_files(tree: DataFrame, spec: UsageSpec, caps: dict[str, int] | None = None) -> DataFrame:
    """The first few files of each kind: ``repo_key, kind, path, rank``, hinted sources first.

    ``caps`` (by kind) is the feature here, by default that of the spec; evidence reads every file.
    The rank limit reaches both sides of the shuffle (WindowGroupLimit), so a repo with
    any number of files sends at most ``cap`` rows per task.
    """
    caps = caps or {
        "definition": spec.caps.definitions,
        "manifest": spec.caps.manifests,
        "source": spec.caps.sources,
    }
    order = Window.partitionBy("repo_key", "kind").orderBy("place")
    cap = F.element_at(
        F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind")
    )
    return (
        ordered_files(tree, spec)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(caps.values()))
        .where(F.col("rank") <= cap)
        .drop("place")
    )


def definition_names(tree: DataFrame, spec: UsageSpec) -> DataFrame:
    """``repo_key, base``: the distinct file names of each repo's definitions."""
    names = tree.where(path_kind(F.col("path"), spec) == "definition")
    return names.select("repo_key", base_name(F.col("path")).alias("base")).distinct()


class KnownNames(NamedTuple):
    """What a scan needs to know of all repos' definition names, of bounded size."""

    known: Column  # struct<held, lengths>, a scalar subquery
    bits: int


def known_names(names: DataFrame) -> KnownNames:
    """A sketch of the names as a trie from their ends: for each length that any name has, the last so
    many characters of every name, and the whole names apart.
    """
    length = F.char_length("base")
    counted = names.agg(F.count("*").alias("names"), F.count_distinct(length).alias("lengths")).first()
    bits = sketch_bits(counted.names * (counted.lengths + 1), NAME_BITS)
    lengths = names.agg(F.array_sort(F.collect_set(length))).scalar()
    upto = F.explode(F.filter("lengths", lambda n: n <= length))
    ends = names.withColumn("lengths", lengths).select("repo_key", "base", upto.alias("n")).select(
        "repo_key", F.right("base", "n").alias("end"), F.lit(False).alias("whole")
    )
    nodes = ends.unionByName(names.select("repo_key", F.col("base").alias("end"), F.lit(True).alias("whole")))
    held = sketch(nodes, "repo_key", "end", "whole", bits=bits)
    return KnownNames(F.struct(held.alias("held"), lengths.alias("lengths")), bits)


def _names_at(repo: Column, tail: Column, known: Column, bits: int) -> Column:
    """The names that end where ``tail`` ends, by their lengths: the walk stops where no name goes on."""

    def holds(end: Column, whole: bool) -> Column:
        return may_hold(known["held"], repo, end, F.lit(whole), bits=bits)

    def step(acc: Column, n: Column) -> Column:
        end = F.right(tail, n)
        names = F.when(holds(end, True), F.array_append(acc["names"], end)).otherwise(acc["names"])
        return F.when(
            acc["on"] & (n <= F.char_length(tail)) & holds(end, False),
            F.struct(F.lit(True).alias("on"), names.alias("names")),
        ).otherwise(F.struct(F.lit(False).alias("on"), acc["names"].alias("names")))

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(True).alias("on"), none.alias("names"))
    shortest = F.get(known["lengths"], F.lit(0))
    return F.when(  # most places end here
        holds(F.right(tail, shortest), False), F.aggregate(known["lengths"], start, step, lambda acc: acc["names"])
    ).otherwise(none)


def _tails(low: Column, width: Column, suffix: str) -> Column:
    """For each place of the suffix in a line the up to ``width`` characters that end with it, distinct."""
    end, back = F.lit(suffix), F.ceil(width / len(suffix)).cast("int")

    def of(parts: Column) -> Column:
        def tail(i: Column) -> Column:
            own = F.get(parts, i)
            before = F.slice(parts, F.greatest(i - back, F.lit(0)) + 1, F.least(i, back) + 1)
            reach = F.when(
                (i == 0) | (F.char_length(own) + len(suffix) >= width), own
            ).otherwise(F.array_join(before, suffix))
            return F.right(F.concat(reach, end), width)

        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts) - 2), tail))

    return let(F.transform(F.split(low, re.escape(suffix), -1), lambda p: F.right(p, width)), of)


def call_lines(repo: Column, text: Column, known: Column, bits: int, spec: UsageSpec) -> Column:
    """Lines that name a definition of the repo or call the client, with 1-based numbers.

    Of a line stay the call flag, a snippet, and the names that it may hold: those that the sketch of all
    names lets through, so nothing leaves for a place that names nothing.
    """
    suffix = F.lit(spec.definition_suffix)
    none = F.array().cast("array<string>")

    def of(known: Column) -> Column:
        def names(low: Column) -> Column:
            width = F.element_at(known["lengths"], -1)
            return F.array_distinct(
                F.flatten(
                    F.transform(
                        _tails(low, width, spec.definition_suffix), lambda t: _names_at(repo, t, known, bits)
                    )
                )
            )

        def told(line: Column) -> Column:
            may_name = F.contains(line["low"], suffix) & (F.size(known["lengths"]) > 0)
            return F.struct(
                line["line"].alias("line"),
                F.left(strip(line["text"]), F.lit(spec.caps.snippet_chars)).alias("snippet"),
                contains_any(line["low"], spec.call_strings).alias("has_call"),
                F.when(may_name, names(line["low"])).otherwise(none).alias("names"),
            )

        numbered = F.transform(
            lines(text),
            lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.lower(t).alias("low")),
        )
        telling = F.filter(
            numbered,
            lambda l: contains_any(l["low"], spec.call_strings) | F.contains(l["low"], suffix),
        )
        return F.filter(F.transform(telling, told), lambda l: l["has_call"] | (F.size(l["names"]) > 0))

    return let(known, of)


def sdk_signals(text: Column, low: Column, source: Column, spec: UsageSpec) -> dict[str, Column]:
    """Client calls, package imports, hosted use and local engine use of one source text.

    Plain searches rule out most files before the regex runs.  The three letters fold to ASCII
    in a case-insensitive regex but not in lower().
    """
    may_call = contains_any(low, tuple(t.lower() for t in spec.call_tokens)) | contains_any(
        text, ("ſ", "İ", "ı")
    )
    calls = F.when(source & may_call, F.regexp_count(text, F.lit(spec.call_regex))).otherwise(0)
    return {
        "calls": calls,
        "imports": source & contains_any(low, spec.import_markers),
        "hosted": source & contains_any(low, spec.hosted_markers),
        "engine": source & contains_any(low, spec.engine_markers),
    }


def _classified(files: DataFrame, spec: UsageSpec) -> DataFrame:
    return (
        files.select("repo_key", "path", "text", path_kind(F.col("path"), spec).alias("kind"))
        .where(F.col("kind").isNotNull())
        .withColumn("low", F.lower("text"))
    )


def sdk_rollup(files: DataFrame, spec: UsageSpec) -> DataFrame:
    """SDK activity per repo over all its source files, without a cap on files."""
    signals = sdk_signals(F.col("text"), F.col("low"), F.col("kind") == "source", spec)
    return (
        _classified(files, spec)
        .select("repo_key", *[c.alias(n) for n, c in signals.items()])
        .groupBy("repo_key")
        .agg(
            F.sum("calls").alias("callsites"),
            F.count_if((F.col("calls") > 0) | F.col("imports")).alias("file_spread"),
            F.bool_or("hosted").alias("hosted"),
            F.bool_or("engine").alias("engine"),
        )
    )


LINES_DDL = "array<struct<line: int, snippet: string, has_call: boolean, names: array<string>>>"


def file_signals(files: DataFrame, spec: UsageSpec, names: DataFrame) -> DataFrame:
    """One row per file that says something: ``repo_key, path, signals``.

    ``names`` are the definitions that lines may name (``definition_names``).
    """
    text, low = F.col("text"), F.col("low")
    source, manifest = F.col("kind") == "source", F.col("kind") == "manifest"
    definition = F.col("kind") == "definition"
    caller = (
        source
        & F.contains(low, F.lit(spec.definition_suffix))
        & contains_any(low, spec.call_strings)
    )
    told = F.struct(
        (manifest & F.contains(low, F.lit(spec.product))).alias("dependency"),
        F.when(source | manifest, words_of(low, spec.platforms)).otherwise(
            F.array().cast("array<string>")
        ).alias("platforms"),
        *[c.alias(n) for n, c in sdk_signals(text, low, source, spec).items()],
        F.when(definition, parse_definition(text)).otherwise(
            F.lit(None).cast(METRICS_DDL)
        ).alias("metrics"),
        F.when(caller, text).alias("caller_text"),
    )

    def says_something(s: Column) -> Column:
        return (
            s["dependency"] | (F.size(s["platforms"]) > 0) | (s["calls"] > 0) | s["imports"]
            | s["hosted"] | s["engine"] | s["metrics"].isNotNull() | s["caller_text"].isNotNull()
        )

    # The generator keeps the test behind the projection, which is compiled as a whole.  As a
    # filter it would be pushed below and every text would be searched twice.
    kept = F.explode(F.filter(F.array("s"), says_something))
    said = _classified(files, spec).select("repo_key", "path", told.alias("s")).select(
        "repo_key", "path", kept.alias("s")
    )
    # Higher-order functions take no subquery, but a column that is one.  Used once, behind the generator,
    # it is put into the projection that uses it and is not carried by any row.
    all_names = known_names(names)
    caller_lines = call_lines(F.col("repo_key"), F.col("s.caller_text"), F.col("_known"), all_names.bits, spec)
    found = F.when(F.col("s.caller_text").isNotNull(), caller_lines).otherwise(F.array().cast(LINES_DDL))
    signals = F.struct(
        *[F.col(f"s.{n}") for n in ("dependency", "platforms", "calls", "imports", "hosted", "engine")],
        found.alias("call_lines"), "s.metrics",
    )
    return said.withColumn("_known", all_names.known).select("repo_key", "path", signals.alias("signals"))
