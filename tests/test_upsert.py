"""The upsert against a search per row on random sheets; lookups and numbering."""

import random

import pytest
from pyspark.sql import functions as F

from usemeter.operators.numbering import number_rows
from usemeter.operators.skew import lookup_join
from usemeter.operators.upsert import upsert


# comparable forms, written out; None matches nothing
NAMES = {"Alpha": "alpha", "alpha ": "alpha", "Beta": "beta", "be  ta": "be ta", "BE TA": "be ta",
         "": "", " ": "", "Gamma": "gamma", "Delta": "delta"}
REPOS = {"https://github.com/o/a": "o/a", "github.com/O/A.git": "o/a", "github.com/o/b": "o/b",
         "none": None, "": None, "github.com": "github.com"}


def expected(sheet, new):
    """Each new row looks from the bottom of the old sheet for its name, then for its repo."""

    def place(name, link):
        below = range(len(sheet) - 1, -1, -1)
        by_name = [i for i in below if sheet[i][0] != "" and NAMES[sheet[i][0]] == NAMES[name]]
        by_repo = [i for i in below if REPOS[link] and REPOS[sheet[i][1]] == REPOS[link]]
        return next(iter(by_name + by_repo), None)

    placed = [(place(n, l), (n, l, t)) for n, l, t in new]
    last = {i: row for i, row in placed if i is not None}
    return [last.get(i, old) for i, old in enumerate(sheet)] + [r for i, r in placed if i is None]


def draw(rng, n, tag):
    return [(rng.choice(list(NAMES)), rng.choice(list(REPOS)), f"{tag}{i}") for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_upsert_equals_a_search_per_row(spark, spec, seed):
    rng = random.Random(seed)
    sheet, new = draw(rng, rng.randint(0, 6), "s"), draw(rng, rng.randint(1, 12), "n")

    def frame(rows, order, first):
        columns = [F.col(c) if c in ("project_name", "repo_link", "notes") else
                   (F.lit(0.0) if c == "score" else F.lit("")).alias(c) for c in spec.sheet_headers]
        df = spark.createDataFrame(
            [(first + i, *r) for i, r in enumerate(rows)],
            f"{order} bigint, project_name string, repo_link string, notes string")
        return df.select(order, *columns)

    merged = upsert(frame(sheet, "row_no", 2), frame(new, "ord", 1), spec).orderBy("row_no").collect()
    want = expected(sheet, new)
    assert [(r.project_name, r.repo_link, r.notes) for r in merged] == want
    first = 2 if sheet else 1
    assert [r.row_no for r in merged] == list(range(first, first + len(want)))


def test_lookup_join_with_hot_and_missing_keys(spark):
    n = 30000
    rows = spark.range(n).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("k"),
    )
    lookup = rows.where("k is not null").groupBy("k").agg(F.max("ord").alias("top")).where("k <> 'k5'")
    got = lookup_join(rows, lookup, "k", spread_by="ord")
    want = rows.join(F.broadcast(lookup), "k", "left")
    assert got.count() == n
    assert got.select("ord", "k", "top").exceptAll(want.select("ord", "k", "top")).count() == 0
    inner = lookup_join(rows, lookup, "k", spread_by="ord", how="inner")
    assert inner.count() == want.where("top is not null").count()


def test_hot_keys_are_spread(spark):
    """With shuffled joins no task gets the hot key's rows alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = spark.range(60000).select(
            F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
        lookup = rows.groupBy("k").agg(F.count("*").alias("c"))
        parts = lookup_join(rows, lookup, "k", spread_by="ord").groupBy(
            F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in parts) < 60000 / 3 / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_clustered_orders_are_numbered_in_even_tasks(spark):
    """Most rows in one narrow range of values, a few far away: no range holds much more than others."""
    ids = spark.range(100_000).select((F.col("id") + F.lit(7 << 34)).alias("o")).union(
        spark.range(300).where("id <> 7").select(F.shiftleft("id", 34).alias("o")))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = number_rows(ids, "o", "n")
        assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 100_299, 100_299)
        sizes = [r["count"] for r in ids.repartitionByRange(16, "o").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 4 * 100_299 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_number_rows_is_dense_and_ordered(spark):
    ids = random.Random(1).sample(range(-10**9, 10**9), 5000) + [5 * 10**9]
    df = spark.createDataFrame([(i,) for i in ids], "o bigint")
    got = number_rows(df, "o", "n", start=10).orderBy("o").collect()
    assert [r.n for r in got] == list(range(11, 11 + len(ids)))
    assert number_rows(df.where("o = 1"), "o", "n").count() == 0
