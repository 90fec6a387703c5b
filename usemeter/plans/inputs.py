"""The supplied tables as inputs of the engine.

Each function maps whole tables, row by row or by plain aggregation, to the shape an
operator expects.  No rows are left out and no texts are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.config import UsageSpec
from usemeter.sources.snapshots import Snapshot

SPEC = UsageSpec.for_product("acme", "Acme")

# Frequent words stand in for tokens, so that every operator meets hits and misses.
CORPUS_SPEC = UsageSpec.for_product("license", "License").with_(
    call_tokens=("the", "and", "of"),
    import_markers=("que", "der"),
    hosted_markers=("released under",),
    engine_markers=("license, version",),
    platforms=("the", "and", "of", "les", "der", "die", "los", "que", "una"),
    competitors=("les", "que"),
    source_patterns=("the ", "and ", "licensed under", "released under", "of the", " la ", "und "),
    call_strings=(" and the ", " of the ", " by the "),
    definition_suffix="tion",
    path_hints=("api", "agent"),
    digest_path_hints=("api",),
)

PAGES_SPEC = SPEC.with_(
    host="example.",
    host_regex=r"example\.(?:com|net|org)",
    source_extensions=("html",),
    definition_suffix="#top",
    path_hints=("en/", "fr/"),
)

MONITOR_SPEC = SPEC.with_(verdict_markers=('"k": 1', '"k": 7', "Significant"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- repo = customer, definition = order, component = lineitem, activity = event ----


def customer_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").alias("_nodes"),
            F.bool_or(F.col("l_returnflag") == "A").alias("_agent"),
            F.bool_or(F.col("l_linestatus") == "O").alias("_llm"),
            F.count_if(F.col("l_returnflag") == "R").alias("_tools"),
        )
    )
    return (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .select(
            F.col("o_custkey").alias("repo_key"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
            (F.col("o_orderstatus") == "F").alias("called"),
            F.coalesce("_nodes", F.lit(0)).alias("nodes"),
            F.coalesce("_agent", F.lit(False)).alias("has_agent"),
            F.coalesce("_llm", F.lit(False)).alias("has_llm"),
            F.coalesce("_tools", F.lit(0)).alias("tool_count"),
        )
    )


def customer_facts(
    spark: SparkSession, sf_dir: str, activity: Column | None = None
) -> DataFrame:
    events = table(spark, sf_dir, "events")
    if activity is not None:
        events = events.where(activity)
    kind = F.col("event_type")
    used = events.groupBy(F.col("user_id").alias("repo_key")).agg(
        F.count_if(kind == "click").alias("_calls"),
        F.size(F.collect_set(kind)).cast("bigint").alias("_spread"),
        F.bool_or(kind == "signup").alias("_hosted"),
        F.bool_or(kind == "error").alias("_competing"),
    )
    no = F.lit(False)
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("repo_key"),
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("dependency"),
        )
        .join(used, "repo_key", "left")
        .select(
            "repo_key", "dependency",
            F.coalesce("_calls", F.lit(0)).alias("callsites"),
            F.coalesce("_spread", F.lit(0)).alias("file_spread"),
            F.coalesce("_hosted", no).alias("hosted"),
            no.alias("engine"),
            F.coalesce("_competing", no).alias("competing"),
            no.alias("blocked"),
            no.alias("scaffold_only"),
        )
    )


# --- documents as a corpus of repos --------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: definitions, manifests, sources and others."""
    group = F.expr("(doc_id div 20) % 10")
    word = F.regexp_extract("text", "[a-z]{0,4}tion", 0)
    doc = F.col("doc_id").cast("string")
    is_definition = group.isin(0, 1)
    path = (
        F.when(
            is_definition,
            F.concat(
                F.lit("pipelines/"), doc, F.lit("/"),
                F.when(word == "", "none.tion").otherwise(word),
            ),
        )
        .when(group == 2, F.concat(F.lit("lib/"), doc, F.lit("/package.json")))
        .when(
            group < 9,
            F.concat(F.when(F.col("lang") == "en", "src/api/").otherwise("src/"), doc, F.lit(".py")),
        )
        .when(F.col("lang") == "de", F.concat(F.lit("p"), doc, F.lit("/.claude/rules/license.md")))
        .otherwise(F.concat(F.lit("docs/"), doc, F.lit(".md")))
    )
    components = F.transform(
        F.sequence(F.lit(1), (F.col("n_chars") % 13).cast("int")),
        lambda i: F.struct(
            i.cast("string").alias("id"),
            F.element_at(
                F.array(*[F.lit(p) for p in ("agent_x", "llm_y", "tool_z", "webhook")]),
                ((i + F.col("doc_id")) % 4).cast("int") + 1,
            ).alias("provider"),
        ),
    )
    components = F.when(F.col("n_chars") % 13 > 0, components).otherwise(
        F.array().cast("array<struct<id: string, provider: string>>")
    )
    definition = F.to_json(
        F.struct(components.alias("components"), F.col("source").alias("project_id"))
    )
    broken = F.col("n_chars") % 17 == 0
    return table(spark, sf_dir, "documents").select(
        corpus_key().alias("repo_key"),
        F.col("doc_id").alias("tree_ord"),
        path.alias("path"),
        F.when(is_definition & broken, F.concat(definition, F.lit("{")))
        .when(is_definition, definition)
        .otherwise(F.col("text"))
        .alias("text"),
    )


def corpus_key() -> Column:
    return F.concat("source", F.lit("/r"), F.expr("doc_id div 2000").cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> Snapshot:
    files = document_files(spark, sf_dir)
    owner = F.substring_index("repo_key", "/", 1)
    repos = (
        table(spark, sf_dir, "documents")
        .select(corpus_key().alias("repo_key"))
        .distinct()
        .select(
            "repo_key",
            F.when(owner == "src19", 404).otherwise(200).alias("status"),
            F.when(owner == "src18", 409).otherwise(200).alias("tree_status"),
            F.lit("main").alias("default_branch"),
            (owner == "src17").alias("tree_truncated"),
        )
    )
    return Snapshot(
        repos,
        files.select("repo_key", "tree_ord", "path"),
        files.select("repo_key", "path", "text"),
    )


def corpus_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer submits one corpus repo, in turn over all there are; some links are blank,
    cut off or unknown."""
    key = F.col("c_custkey")
    ranges = table(spark, sf_dir, "documents").agg(F.max(F.expr("doc_id div 2000")) + 1).scalar()
    repo = F.concat(
        F.lit("https://GitHub.com/src"), (key % 20).cast("string"), F.lit("/r"),
        (F.expr("c_custkey div 20") % ranges).cast("string"), F.lit(".git"),
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("ord"),
        F.concat(F.lit("Team "), F.expr("c_custkey div 3").cast("string")).alias("project"),
        F.col("c_name").alias("names"),
        F.when(F.col("c_nationkey") % 2 == 0, "a@b.example").otherwise("").alias("emails"),
        F.when(F.col("c_nationkey") == 7, "n/a")
        .when(F.col("c_nationkey") == 8, "https://github.com/solo")
        .when(F.col("c_nationkey") == 9, "https://github.com/nobody/r0")
        .otherwise(repo)
        .alias("github"),
        F.col("c_mktsegment").alias("feedback"),
        F.when(F.col("c_nationkey") == 1, "www.demo.example/x).").otherwise("").alias("demo"),
        F.lit(None).cast("string").alias("deployed"),
    )


def corpus_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as replies: prose with objects inside, some of them unusable."""
    turn = F.col("turn")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("about "), F.col("role")).alias("description"),
            F.concat(F.lit("turn "), turn.cast("string")).alias("license_usage"),
            F.struct(F.lit(1).alias("x")).alias("more"),
        )
    )
    reply = (
        F.when(turn % 4 == 0, F.concat(F.col("text"), F.lit(" {no} "), F.col("text")))
        .when(turn % 4 == 1, F.concat(F.col("text"), good, F.lit(' {"other": 1} '), F.col("text")))
        .when(turn % 4 == 2, F.concat(F.lit('{"justification": "early"} } '), F.col("text"), good))
        .otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```\n"), F.col("text")))
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("ord"), (turn + 1).cast("int").alias("attempt"),
        reply.alias("reply"), "turn", "role", "text",
    )


# --- other stand-ins ------------------------------------------------------------------


def lineitem_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as a definition file's text; some are cut off or have text behind."""
    n = (F.col("l_linenumber") + F.col("l_partkey") % 6).cast("int")
    names = F.array(*[F.lit(p) for p in ("agent_x", "llm_y", "tool_z", "webhook", "memory_m")])
    components = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(names, ((i * i + F.col("l_suppkey")) % 5).cast("int") + 1)
            .alias("provider")
        ),
    )
    text = F.to_json(
        F.struct(components.alias("components"), F.col("l_returnflag").alias("project_id"))
    )
    text = (
        F.when(F.col("l_quantity") == 1, F.concat(text, F.lit(" extra")))
        .when(F.col("l_quantity") == 2, F.concat(F.lit("["), text))
        .otherwise(text)
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("text")
    )


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo_key"),
        F.col("page_id").alias("tree_ord"),
        F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"),
    )


def page_corpus(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Pages as files of small repos, seven running numbers of a host each; none has a manifest."""
    files = table(spark, sf_dir, "pages").select(
        F.concat(
            F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("/"),
            F.expr("page_id div 7").cast("string"),
        ).alias("repo_key"),
        F.col("page_id").alias("tree_ord"),
        F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"),
        F.col("html").alias("text"),
    )
    repos = files.select(
        "repo_key", F.lit(200).alias("status"), F.lit(200).alias("tree_status"),
        F.lit("main").alias("default_branch"), F.lit(False).alias("tree_truncated"),
    ).distinct()
    return Snapshot(
        repos, files.select("repo_key", "tree_ord", "path"), files.select("repo_key", "path", "text")
    )


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ord"),
        F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string")).alias("project"),
        F.col("url").alias("github"),
        F.when(F.col("page_id") % 2 == 0, "seen").otherwise("").alias("notes"),
    )


def order_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions of their customer's repo."""
    cust = F.col("o_custkey").cast("string")
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("project"),
        F.lit("").alias("names"),
        F.lit("").alias("emails"),
        F.when(priority == "1-URGENT", "tbd")
        .when(priority == "2-HIGH", F.concat(F.lit("github.com/"), cust))
        .otherwise(F.concat(F.lit("git@github.com:Cust"), cust, F.lit("/Repo?tab=1")))
        .alias("github"),
        priority.alias("feedback"),
    )


def customer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access status of every customer's repo; nations stand in for hosts that answer badly."""
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust"), F.col("c_custkey").cast("string"), F.lit("/repo")).alias("repo_key"),
        F.when(nation < 5, 404).when(nation < 8, None).otherwise(200).alias("status"),
        F.when(nation < 12, 409).otherwise(200).alias("tree_status"),
    )


def sheet_columns(spec: UsageSpec, given: dict[str, Column]) -> list[Column]:
    return [
        given.get(c, F.lit(0.0) if c == "score" else F.lit("")).alias(c) for c in spec.sheet_headers
    ]


def standing_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheet rows.  Names repeat in pairs, some are blank; repos repeat in fours."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (key + 2).alias("row_no"),
        *sheet_columns(
            SPEC,
            {
                "project_name": F.when(F.col("c_nationkey") == 3, "").otherwise(
                    F.concat(F.lit(" Cust  "), F.expr("c_custkey div 2").cast("string"))
                ),
                "repo_link": F.when(F.col("c_nationkey") == 5, "none").otherwise(
                    F.concat(F.lit("https://github.com/o/R"), F.expr("c_custkey div 4").cast("string"))
                ),
                "notes": F.col("c_mktsegment"),
                "score": F.col("c_acctbal"),
            },
        ),
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as new results: hits by name, by repo only, several per row, and new rows."""
    cust = F.col("o_custkey")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        *sheet_columns(
            SPEC,
            {
                "project_name": F.when(
                    status == "F", F.concat(F.lit("cust "), F.expr("o_custkey div 2").cast("string"))
                )
                .when(status == "O", F.concat(F.lit("new "), (cust % 50).cast("string")))
                .otherwise(""),
                "repo_link": F.when(
                    F.col("o_orderpriority") < "4",
                    F.concat(F.lit("github.com/O/r"), F.expr("o_custkey div 3").cast("string"), F.lit(".git")),
                ).otherwise("-"),
                "notes": F.col("o_orderpriority"),
                "score": F.col("o_totalprice"),
            },
        ),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a run's progress stream; sign-ups are cut off in the middle."""
    kind, key = F.col("event_type"), F.col("event_id")
    payload = F.to_json(
        F.struct(
            F.when(key % 3 == 0, "Moderate").otherwise("None").alias("tag"),
            F.when(key % 5 == 0, "Yes").alias("backbone"),
            F.when(key % 11 != 0, key % 7 != 0).alias("repo_accessible"),
        )
    )
    line = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("run_id"), key.alias("seq"),
            F.when(kind == "error", "error").when(kind == "view", "stage").otherwise("result")
            .alias("event"),
            (key % 10).cast("int").alias("idx"), F.lit(10).alias("total"), payload.alias("payload"),
        )
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "signup", F.left(line, F.length(line) - 3)).otherwise(line).alias("value"),
    )
