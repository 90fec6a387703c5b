"""Repo snapshot to evidence: one nested row per repo."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.operators.clustering import may_hold, sketch, sketch_bits
from usemeter.operators.files import (
    base_name, definition_names, file_signals, ordered_files, tree_facts,
)
from usemeter.session import stored


def open_repos(repos: DataFrame) -> DataFrame:
    """Keys of the repos whose files were listed."""
    return repos.where("status = 200 and tree_status = 200").select("repo_key")


class Found(NamedTuple):
    """What the files of open repos say, one row per file or per line; nothing is gathered."""

    files: DataFrame  # repo_key, path, kind, place, signals (null: the text says nothing)
    named: DataFrame  # repo_key, base, path, place, line, snippet, has_call: a line names a base
    calls: DataFrame  # repo_key, path, line, snippet: a line of a caller calls the client
    tree: DataFrame  # the paths of open repos


def find(repos: DataFrame, tree: DataFrame, files: DataFrame, spec: UsageSpec) -> Found:
    """Every file of every open repo, and the lines that name a definition or call the client.

    Texts are read once: only those of open repos, which a sketch of their keys tells at the scan, are
    looked at, and what they say is stored.  A name counts wherever it ends in a line; lines leave the
    scan with the names that a sketch of all names lets through, and an equi-join on (repo, name) keeps
    the true ones.
    """
    reachable = stored(open_repos(repos), "open")
    bits = sketch_bits(reachable.count())
    may_be_open = may_hold(sketch(reachable, "repo_key", bits=bits), "repo_key", bits=bits)
    listed = tree.where(may_be_open)
    names = stored(definition_names(listed, spec), "names")
    signals = file_signals(files.where(may_be_open), spec, names)
    found = stored(
        ordered_files(listed, spec).join(reachable, "repo_key", "left_semi")
        .join(signals, ["repo_key", "path"], "left"), "found"
    )
    told = (
        found.where("kind = 'source'")
        .select("repo_key", "path", "place", F.explode("signals.call_lines").alias("l"))
        .select("repo_key", "path", "place", "l.*")
    )
    named = (
        told.select("repo_key", "path", "place", "line", "snippet", "has_call", F.explode("names").alias("base"))
        .join(names, ["repo_key", "base"])
    )
    calls = told.where("has_call").select("repo_key", "path", "line", "snippet")
    return Found(found, named, calls, listed.join(reachable, "repo_key", "left_semi"))


def called_definitions(found: Found) -> DataFrame:
    """``repo_key, path, place, base, metrics, caller, caller_place``: caller is null if none.

    The first source in candidate order that names the definition counts.
    """
    first = found.named.groupBy("repo_key", "base").agg(
        F.min(F.struct("place", "path")).alias("first")
    )
    return (
        found.files.where("kind = 'definition'")
        .select("repo_key", "path", "place", base_name(F.col("path")).alias("base"),
                F.col("signals.metrics").alias("metrics"))
        .join(first, ["repo_key", "base"], "left")
        .select("repo_key", "path", "place", "base", "metrics", F.col("first.path").alias("caller"))
    )


def call_sites(found: Found, definitions: DataFrame) -> DataFrame:
    """All call sites: ``repo_key, path, file, line, snippet``, lines of the definition's caller
    that name it or call the client."""
    called = definitions.where("caller is not null")
    naming = called.join(
        found.named.select("repo_key", "base", F.col("path").alias("caller"), "line", "snippet",
                           "has_call").where("not has_call"),
        ["repo_key", "base", "caller"],
    )
    calling = called.join(
        found.calls.withColumnRenamed("path", "caller"), ["repo_key", "caller"]
    )
    columns = ("repo_key", "path", F.col("caller").alias("file"), "line", "snippet")
    return naming.select(*columns).unionByName(calling.select(*columns))


def verified_definitions(found: Found, spec: UsageSpec) -> DataFrame:
    """``repo_key, path, place, metrics, called, n_sites, call_sites``: the sites counted, the first
    few shown.

    A caller's own lines are counted and its first ones taken once per file, so the number of
    rows is that of the definitions.
    """
    shown = spec.caps.call_sites
    site = F.struct("line", "snippet")
    first = lambda sites: F.slice(F.array_sort(sites), 1, shown)
    definitions = called_definitions(found)
    naming = (
        found.named.where("not has_call").groupBy("repo_key", "base", F.col("path").alias("caller"))
        .agg(F.count("*").alias("_n"), first(F.collect_list(site)).alias("_named"))
    )
    calls = F.filter("signals.call_lines", lambda l: l["has_call"])
    calling = found.files.where("kind = 'source'").select(
        "repo_key", F.col("path").alias("caller"), F.size(calls).alias("_calls"),
        F.transform(
            F.slice(calls, 1, shown),
            lambda l: F.struct(l["line"].alias("line"), l["snippet"].alias("snippet")),
        ).alias("_calling"),
    ).where("_calls > 0")
    none = F.array().cast("array<struct<line: int, snippet: string>>")
    sites = first(F.concat(F.coalesce("_named", none), F.coalesce("_calling", none)))
    return (
        definitions.join(naming, ["repo_key", "base", "caller"], "left")
        .join(calling, ["repo_key", "caller"], "left")
        .select(
            "repo_key", "path", "place", "metrics", F.col("caller").isNotNull().alias("called"),
            (F.coalesce("_n", F.lit(0)) + F.coalesce("_calls", F.lit(0))).cast("int").alias("n_sites"),
            F.transform(
                sites,
                lambda s: F.struct(
                    F.col("caller").alias("file"), s["line"].alias("line"),
                    s["snippet"].alias("snippet"),
                ),
            ).alias("call_sites"),
        )
    )


def repo_facts(found: Found) -> DataFrame:
    """Partial aggregates of all files per repo; sets are bounded by the dictionary."""
    s = F.col("signals")
    return found.files.groupBy("repo_key").agg(
        F.coalesce(F.bool_or(s["dependency"]), F.lit(False)).alias("dependency"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(s["platforms"])))).alias(
            "other_platforms"
        ),
        F.coalesce(F.sum(s["calls"]), F.lit(0)).cast("int").alias("callsites"),
        F.count_if((s["calls"] > 0) | s["imports"]).cast("int").alias("file_spread"),
        F.coalesce(F.bool_or(s["hosted"]), F.lit(False)).alias("hosted"),
        F.coalesce(F.bool_or(s["engine"]), F.lit(False)).alias("engine"),
        F.count_if(F.col("kind") == "definition").alias("_definitions"),
    )


def gather(repos: DataFrame, tree: DataFrame, files: DataFrame, spec: UsageSpec) -> DataFrame:
    """Evidence of every repo, from all files of the open ones.

    ``repos(repo_key, status, tree_status)``, ``tree(repo_key, tree_ord, path)``,
    ``files(repo_key, path, text)``.  Files are joined on (repo, path), which no single repo
    can skew.  A repo's row lists its definitions; ``find`` has everything in long form.
    """
    found = find(repos, tree, files, spec)
    pipe = F.struct("path", "metrics", "called", "n_sites", "call_sites")
    pipes = (
        verified_definitions(found, spec).groupBy("repo_key")
        .agg(F.array_sort(F.collect_list(F.struct("place", pipe.alias("p")))).alias("_pipes"))
        .select("repo_key", F.transform("_pipes", lambda x: x["p"]).alias("pipes"))
    )
    is_open = (F.col("status") == 200) & (F.col("tree_status") == 200)
    none = F.array()
    listed = tree_facts(found.tree, spec)
    joined = (
        repos.join(listed, "repo_key", "left").join(repo_facts(found), "repo_key", "left")
        .join(pipes, "repo_key", "left")
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return joined.select(
        "repo_key",
        (F.col("status") == 200).alias("accessible"),
        ((F.col("status") == 200) & ~is_open).alias("fetch_incomplete"),
        "status",
        F.when(
            (F.col("status") == 200) & ~is_open,
            F.format_string(spec.TREE_NOTE, F.col("tree_status").cast("string")),
        ).alias("note"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        flag("dependency").alias("dependency"),
        (
            flag("has_scaffold") & ~flag("dependency")
            & (F.coalesce("_definitions", F.lit(0)) == 0)
        ).alias("scaffold_only"),
        F.coalesce("other_platforms", none.cast("array<string>")).alias("other_platforms"),
        F.struct(
            F.coalesce("callsites", F.lit(0)).alias("callsites"),
            F.coalesce("file_spread", F.lit(0)).alias("file_spread"),
            flag("hosted").alias("hosted"),
            flag("engine").alias("engine"),
        ).alias("sdk"),
        F.coalesce("pipes", none.cast(PIPES_DDL)).alias("pipes"),
    )


PIPES_DDL = (
    "array<struct<path: string, metrics: struct<nodes: int, providers: array<string>, "
    "has_agent: boolean, has_llm: boolean, tool_count: int, project_id: string>, "
    "called: boolean, n_sites: int, "
    "call_sites: array<struct<file: string, line: int, snippet: string>>>>"
)
