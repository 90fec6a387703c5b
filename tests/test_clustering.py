"""Clustered tables and sketches: what is read, and that nothing is lost."""

import random

import pytest
from pyspark.sql import functions as F
from test_evidence import flow, tables

from usemeter.operators.clustering import (
    SLOTS, in_slots, may_hold, sketch, slot_ranges, wanted_slots, write_clustered,
)
from usemeter.plans.verification import submitted_only, verify
from usemeter.sources.snapshots import REPLIES_DDL, Snapshot, of_repos, read_snapshot, write_snapshot


def rows_scanned(df):
    """Rows that left the file scans of ``df`` when it ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    open_ = [plan]
    while open_:
        node = open_.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            open_.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            open_.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("seed", range(5))
def test_ranges_hold_all_slots(seed):
    rnd = random.Random(seed)
    slots = sorted(rnd.sample(range(SLOTS), rnd.choice([1, 5, 700])))
    for most in (1, 3, 256):
        ranges = slot_ranges(slots, most)
        assert len(ranges) <= most and all(any(a <= s <= b for a, b in ranges) for s in slots)
        assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    assert slot_ranges(list(range(5, 9)), 3) == [(5, 8)]


def test_sketch_holds_its_keys(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key", "id AS n")
    tried = spark.range(30_000).selectExpr("concat('k', id) AS key", "id AS n")
    for bits in (1 << 15, 1 << 20):
        hit = tried.withColumn("hit", may_hold(sketch(keys, "key", "n", bits=bits), "key", "n", bits=bits))
        counts = {r.own: r.n for r in hit.where("hit").groupBy((F.col("n") < 3000).alias("own")).agg(F.count("*").alias("n")).collect()}
        assert counts[True] == 3000 and counts.get(False, 0) < 2.5 * 27_000 * 3000 / bits
    nothing = sketch(keys.limit(0), "key", bits=1 << 15)
    assert tried.where(may_hold(nothing, "key", bits=1 << 15)).count() == 0


def test_slots_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(200_000).selectExpr("concat('k', id % 20000) AS key", "repeat(md5(string(id)), 8) AS text")
    write_clustered(df, path, ("key",), ("text",), files=4, group_bytes=1 << 18)
    back = spark.read.parquet(path)
    for n, scans in ((0, 1), (1, 1), (40, 1), (600, 1), (600, 4)):
        keys = spark.range(n).selectExpr("concat('k', id * 7) AS key")
        slots = wanted_slots(keys, "key")
        read = in_slots(back, slots, scans)
        assert read.join(keys, "key", "left_semi").count() == 10 * n
        if n in (1, 40):
            assert 10 * n <= rows_scanned(read) <= 1200 * n  # of 200,000: a row group a key
    assert in_slots(df, [1]) is df  # not clustered: as it is
    assert in_slots(back, list(range(SLOTS))) is back


def test_a_key_with_most_rows_fills_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40_000).selectExpr("if(id % 3 > 0, 'hot', concat('k', id)) AS key", "concat('p', id) AS path")
    write_clustered(df, path, ("key",), ("path",), files=8)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 8 and max(r["count"] for r in per_file) < 10_000


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    out = {}
    for i in range(1500):
        text = "client.use('main.pipe')\n" * (i % 3) + "x = AcmeClient()\n" * (i % 5) + f"# {rnd.randbytes(500).hex()}\n"
        out[f"own{i % 40}/repo{i}"] = [
            ("package.json", "acme" if i % 2 else "-"), ("main.pipe", flow("agent_x", "llm_y")),
            *[(f"src/f{j}.py", text + str(j)) for j in range(4)],
        ]
    return out


def test_verifying_few_repos_reads_their_row_groups(spark, spec, corpus, tmp_path):
    """Twelve repos of 1,500: the same results, from a small part of the texts."""
    closed = [("own1/gone", 404, None, None, None), ("own2/half", 200, 409, "main", None)]
    plain = tables(spark, corpus, closed)
    path = str(tmp_path / "snapshot")
    write_snapshot(Snapshot(*plain), path, files=3, group_bytes=1 << 16)
    clustered = read_snapshot(spark, path)
    chosen = list(corpus)[::125] + ["own1/gone", "own2/half", "own3/unknown"]
    fields = ("project", "names", "emails", "github", "feedback", "demo", "deployed")
    rows = [(i, f"P{i}", "", "", f"https://github.com/{k}", "", "", "") for i, k in enumerate(chosen)]
    submissions = spark.createDataFrame(rows, "ord bigint, " + ", ".join(f"{f} string" for f in fields))
    replies = spark.createDataFrame([], REPLIES_DDL.replace("ord string", "ord bigint"))
    order = lambda df: sorted(map(str, df.collect()))
    want = order(verify(submissions, Snapshot(*plain), replies, spec))
    assert order(verify(submissions, clustered, replies, spec)) == want
    part = submitted_only(clustered, submissions, spec)
    assert rows_scanned(clustered.files) == 1500 * 6
    assert rows_scanned(part.files) < 1500 * 6 / 4  # the row groups of twelve repos
    assert "slot" in part.files._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:40]


def test_snapshots_of_both_kinds_are_read(spark, spec, corpus, tmp_path):
    plain = tables(spark, corpus)
    for name, df in zip(("repos", "repo_tree", "repo_files"), plain):
        df.write.parquet(str(tmp_path / "plain" / name))
    keys = spark.createDataFrame([("own0/repo0",), ("x/y",)], "repo_key string")
    snapshot = of_repos(read_snapshot(spark, str(tmp_path / "plain")), keys)
    assert snapshot.repos.count() == 1 and snapshot.files.count() == 9000
