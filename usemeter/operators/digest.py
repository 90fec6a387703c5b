"""The compact evidence digest: what was found, as short text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.functions.dictionary import words_of
from usemeter.functions.text import lines, strip
from usemeter.operators.evidence import open_repos
from usemeter.operators.files import ordered_files, path_kind, tree_facts


def dependency_lines(files: DataFrame, spec: UsageSpec, *keep: str) -> DataFrame:
    """Every line that names the product: ``*keep, line_no, line``."""
    return (
        files.where(F.contains(F.lower("text"), F.lit(spec.product)))
        .select(*keep, F.posexplode(lines(F.col("text"))).alias("at", "raw"))
        .where(F.contains(F.lower("raw"), F.lit(spec.product)))
        .select(*keep, (F.col("at") + 1).cast("bigint").alias("line_no"),
                strip(F.col("raw")).alias("line"))
    )


def source_patterns(files: DataFrame, spec: UsageSpec, *keep: str) -> DataFrame:
    """Every (file, pattern) found: ``*keep, pattern_no, pattern``."""
    found = words_of(F.col("low"), spec.source_patterns)
    listed = F.array(*[F.lit(p) for p in spec.source_patterns])
    return (
        files.withColumn("low", F.lower("text"))
        .select(*keep, F.explode(found).alias("pattern"))
        .withColumn("pattern_no", F.array_position(listed, F.col("pattern")).cast("int"))
    )


def first_patterns(hits: DataFrame, spec: UsageSpec, key: str, order: str) -> DataFrame:
    """The first hits per ``key`` in file order, then pattern order, with their ``rank``."""
    ordered = Window.partitionBy(key).orderBy(order, "pattern_no")
    return hits.withColumn("rank", F.row_number().over(ordered)).where(
        F.col("rank") <= spec.caps.source_signals
    )


def platforms_per_repo(files: DataFrame, spec: UsageSpec) -> DataFrame:
    """``repo_key, platforms``: the sorted distinct dictionary words of a repo's texts."""
    found = files.select("repo_key", F.explode(words_of(F.lower("text"), spec.platforms)).alias("p"))
    return found.groupBy("repo_key").agg(F.array_sort(F.collect_set("p")).alias("platforms"))


def digest(repos: DataFrame, tree: DataFrame, files: DataFrame, spec: UsageSpec) -> DataFrame:
    """One digest row per open repo, over all its files.

    The lists show their first entries (``spec.caps``); ``pipe_file_count``, ``dependency_count``
    and ``signal_count`` count all of them, and ``dependency_lines`` and ``source_patterns`` list
    them in full.  Entries are ranked in long form, where the rank limit is applied on both sides of
    the shuffle, so no repo's files are gathered beyond what is shown.
    """
    kind, low = F.col("kind"), F.col("low")
    source, manifest = kind == "source", kind == "manifest"
    none = F.array().cast("array<string>")
    found_lines = F.transform(
        F.filter(lines(F.col("text")), lambda l: F.contains(F.lower(l), F.lit(spec.product))),
        lambda l: F.concat(F.col("path"), F.lit(": "), strip(l)),
    )
    found_patterns = F.transform(
        words_of(low, spec.source_patterns), lambda p: F.concat(F.col("path"), F.lit(": "), p)
    )
    speaking = (
        files.select("repo_key", "path", "text", path_kind(F.col("path"), spec).alias("kind"))
        .where(source | manifest)
        .withColumn("low", F.lower("text"))
        .select(
            "repo_key", "path",
            F.when(manifest & F.contains(low, F.lit(spec.product)), found_lines)
            .when(source, found_patterns).otherwise(none).alias("said"),
            words_of(low, spec.platforms).alias("platforms"),
        )
        .where((F.size("said") > 0) | (F.size("platforms") > 0))
    )
    found = (
        ordered_files(tree, spec, spec.digest_hint_regex)
        .join(open_repos(repos), "repo_key", "left_semi")
        .join(speaking, ["repo_key", "path"], "left")
    )
    said = F.when(kind == "definition", F.array("path")).otherwise(F.coalesce("said", none))
    shown = F.create_map(
        F.lit("definition"), F.lit(spec.caps.definitions),
        F.lit("manifest"), F.lit(spec.caps.source_signals),
        F.lit("source"), F.lit(spec.caps.source_signals),
    )
    order = Window.partitionBy("repo_key", "kind").orderBy("place", "n")
    first = (
        found.select("repo_key", "kind", "place", F.posexplode(said).alias("n", "entry"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(spec.caps.definitions, spec.caps.source_signals))
        .where(F.col("rank") <= F.element_at(shown, F.col("kind")))
    )

    def shown_of(which: str) -> Column:
        entries = F.array_sort(
            F.collect_list(F.when(F.col("kind") == which, F.struct("rank", "entry")))
        )
        return F.transform(entries, lambda e: e["entry"])

    lists = first.groupBy("repo_key").agg(
        shown_of("definition").alias("pipe_files"), shown_of("manifest").alias("dependencies"),
        shown_of("source").alias("source_signals"),
    )
    count = lambda which: F.sum(F.when(kind == which, F.size(said)).otherwise(0))
    counts = found.groupBy("repo_key").agg(
        count("definition").alias("pipe_file_count"), count("manifest").alias("dependency_count"),
        count("source").alias("signal_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("platforms")))).alias("other_platforms"),
    )
    joined = (
        repos.join(open_repos(repos), "repo_key", "left_semi")
        .join(tree_facts(tree, spec), "repo_key", "left")
        .join(counts, "repo_key", "left").join(lists, "repo_key", "left")
    )
    filled = joined.withColumns(
        {c: F.coalesce(c, none) for c in ("pipe_files", "dependencies", "source_signals", "other_platforms")}
        | {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("pipe_file_count", "dependency_count", "signal_count")}
    )
    nothing = (F.col("pipe_file_count") + F.col("dependency_count") + F.col("signal_count")) == 0
    return filled.select(
        "repo_key", "default_branch",
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        "pipe_files", "pipe_file_count",
        F.coalesce("definitions_folder", F.lit(False)).alias("definitions_folder"),
        "dependencies", "dependency_count", "source_signals", "signal_count", "other_platforms",
        (F.coalesce("has_scaffold", F.lit(False)) & nothing).alias("scaffold_only"),
        F.coalesce("tree_truncated", F.lit(False)).alias("tree_truncated"),
    )
