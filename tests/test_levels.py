"""Levels of keyed states, and the sheet that is kept by its key index."""

import random

import pytest
from pyspark.sql import functions as F
from test_clustering import rows_scanned

from usemeter.operators.upsert import upsert
from usemeter.streaming import ranges, upserts
from usemeter.streaming.levels import Levels

DDL = "key string, value bigint, _batch bigint"


def newest(rows):
    return rows.groupBy("key").agg(F.max_by("value", "_batch").alias("value"), F.max("_batch").alias("_batch"))


def levels(spark, tmp_path, fanout=3):
    return Levels(spark, str(tmp_path / "levels"), ("key",), DDL, newest, fanout, group_bytes=1 << 16)


def test_lookup_finds_the_rows_of_its_keys(spark, tmp_path):
    own, rnd, truth = levels(spark, tmp_path, fanout=2), random.Random(1), {}
    own.write_base(spark.createDataFrame([(f"k{i}", i, -1) for i in range(300)], DDL))
    truth.update({f"k{i}": i for i in range(300)})
    for batch in range(5):
        rows = {f"k{rnd.randint(0, 600)}": rnd.randint(0, 10**6) for _ in range(20)}
        own.add(spark.createDataFrame([(k, v, batch) for k, v in rows.items()], DDL), batch)
        truth.update(rows)
        asked = [f"k{rnd.randint(0, 700)}" for _ in range(30)]
        wanted = spark.createDataFrame([(k,) for k in set(asked)], "key string")
        found = {r.key: r.value for r in newest(own.lookup(wanted)).collect()}
        assert found == {k: truth[k] for k in asked if k in truth}
    assert len(own.open_levels()) == 3  # base, four batches, the fifth
    assert {r.key: r.value for r in newest(own.all_rows()).collect()} == truth
    seen = newest(own.lookup(spark.createDataFrame([("k1",)], "key string"), before=0)).collect()
    assert [r.value for r in seen] == [1]
    names = {p.name for p in (tmp_path / "levels" / "sketches").iterdir()}
    assert "part=0-3" in names and "part=0-0" not in names  # those of levels merged before are gone


def test_no_keys_and_null_keys(spark, tmp_path):
    own = levels(spark, tmp_path)
    none = spark.createDataFrame([], "key string")
    assert own.lookup(none).count() == 0 and own.all_rows().count() == 0
    own.add(spark.createDataFrame([(None, 1, 0), ("a", 2, 0)], DDL), 0)
    assert own.lookup(none).count() == 0
    assert [r.value for r in own.lookup(spark.createDataFrame([(None,)], "key string")).collect()] == [1]


@pytest.mark.parametrize("rows", [20_000, 200_000])
def test_a_lookup_reads_its_keys_only(spark, tmp_path, rows):
    """Ten times the table, the same few rows read."""
    own = levels(spark, tmp_path)
    base = spark.range(rows).selectExpr("concat('key', id) AS key", "id AS value", "-1L AS _batch")
    own.write_base(base)
    wanted = spark.range(5).selectExpr("concat('key', id * 17) AS key")
    found = own.lookup(wanted)
    assert found.count() == 5
    assert rows_scanned(found) < 16_000


def test_a_merge_is_worked_out_once(spark, tmp_path):
    """Its rows serve the sketch, the sample of ranges and the level."""
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(value):
        worked_out.add(1)
        return value

    merge = lambda rows: newest(rows).select("key", seen.asNondeterministic()("value").alias("value"), "_batch")
    own = Levels(spark, str(tmp_path / "levels"), ("key",), DDL, merge, fanout=2)
    for batch in range(2):
        own.add(spark.createDataFrame([(f"k{i}", i, batch) for i in range(batch, 10)], DDL), batch)
    assert worked_out.value == 10
    assert {r.key: r.value for r in newest(own.all_rows()).collect()} == {f"k{i}": i for i in range(10)}


def sheet_rows(spark, spec, rows, order):
    df = spark.createDataFrame(rows, f"{order} bigint, project_name string, repo_link string, notes string")
    given = ("project_name", "repo_link", "notes")
    return df.select(order, *[
        F.col(c) if c in given else (F.lit(0.0) if c == "score" else F.lit("")).alias(c) for c in spec.sheet_headers])


def picked(df):
    return sorted(((r.row_no, r.project_name, r.repo_link, r.notes) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, fanout", [(1, 2), (2, 8)])
def test_batches_equal_upserts_one_after_the_other(spark, spec, tmp_path, seed, fanout):
    """Names and repos that later batches bring, rename, move and repeat."""
    rnd = random.Random(seed)
    names = [None, "", " ", "A", "a ", "B", "b  c", "B C", "D", "e", "F"]
    repos = [None, "-", "github.com/o/r1", "https://github.com/O/R1.git", "github.com/o/r2", "github.com/o/r3", "github.com/o/r4"]
    row = lambda i, tag: (i, rnd.choice(names), rnd.choice(repos), f"{tag}{i}")
    base_rows = [row(i + 2, "old") for i in range(8)]
    batches = [[row(i, f"b{n}-") for i in range(rnd.randint(1, 9))] for n in range(4)]
    base, arriving, out, log = (str(tmp_path / x) for x in ("base", "in", "out", "log"))
    sheet_rows(spark, spec, base_rows, "row_no").write.parquet(base)
    want = spark.read.parquet(base)
    for i, rows in enumerate(batches):
        new = sheet_rows(spark, spec, rows, "ord")
        new.coalesce(1).write.parquet(f"{arriving}/{i}")
        kept = str(tmp_path / f"want{i}")
        upsert(want, new, spec).write.parquet(kept)
        want = spark.read.parquet(kept)
    stream = (
        spark.readStream.schema(sheet_rows(spark, spec, batches[0], "ord").schema)
        .option("maxFilesPerTrigger", 1).parquet(f"{arriving}/*")
    )
    start = lambda: upserts.upsert_stream(spark, base, stream, out, log, spec, fanout)
    start().awaitTermination()
    assert picked(upserts.current_sheet(spark, base, out)) == picked(want)
    ranges.forget_commit(spark, log, len(batches) - 1)  # the last batch comes again
    start().awaitTermination()
    assert picked(upserts.current_sheet(spark, base, out)) == picked(want)


def test_a_batch_does_not_read_the_sheet(spark, spec, tmp_path):
    """The sheet may be gone once it is indexed: batches are placed by the index alone."""
    index = upserts.key_index(spark, str(tmp_path / "out"), 8)
    rows = [(i, f"name {i}", f"github.com/o/r{i}", "") for i in range(3000)]
    upserts.index_sheet(index, sheet_rows(spark, spec, rows, "row_no"), spec)
    batch = sheet_rows(spark, spec, [(1, "NAME  7", "-", ""), (2, "x", "github.com/o/R9", ""), (3, "y", "-", "")], "ord")
    placed = {r.ord: r for r in upserts.place_batch(index, batch, 0, spec).collect()}
    assert {o: r.row_no for o, r in placed.items()} == {1: 7, 2: 9, 3: 3000}
    assert (placed[1].old_name, placed[1].old_repo, placed[1].repo) == ("name 7", "o/r7", None)
    assert (placed[2].old_name, placed[2].old_repo) == ("name 9", "o/r9")
