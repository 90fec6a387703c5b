"""Streams against the same operators on the whole input at once."""

import json
import math

import pytest
from pyspark.sql import functions as F

from usemeter.streaming import monitor, ranges, runs, upserts


def write_lines(folder, name, events, broken=()):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(e) for e in events] + list(broken)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def event(seq, kind, idx=None, run="r1", total=None, **payload):
    return dict(run_id=run, seq=seq, event=kind, idx=idx, total=total, payload=json.dumps(payload))


@pytest.fixture
def source(spark, tmp_path):
    """Two files and one of them per batch, so partial rows have to be merged."""
    folder = tmp_path / "events"
    write_lines(folder, "1.json", [
        event(0, "start", total=3), event(1, "stage", 1), event(2, "stage", 2),
        event(3, "result", 1, total=3, tag="Less", backbone="No"),
        event(0, "start", run="r2", total=2)], broken=['{"run_id": "r2", "seq"'])
    write_lines(folder, "2.json", [
        event(4, "result", 2, total=3, tag="Moderate", backbone="Yes"), event(5, "stage", 3),
        event(6, "error", 3, total=3, reason="x"), event(1, "result", 1, run="r2", tag="Less")])
    stream = (
        spark.readStream.schema(runs.EVENTS_DDL).option("maxFilesPerTrigger", 1)
        .option("columnNameOfCorruptRecord", "_broken").json(str(folder))
    )
    return runs.route_errors(stream, "worker error: ")


def partials(spark, tmp_path, stream, reduce_batch):
    out = str(tmp_path / "out")
    runs.write_partials(stream, reduce_batch, out, str(tmp_path / "log")).awaitTermination()
    assert len(list((tmp_path / "out").glob("part=*"))) == 2
    return runs.read_partials(spark, out)


def test_counts_with_failed_items(spark, tmp_path, source):
    got = runs.merge_counts(
        partials(spark, tmp_path, source.where("is_result"), runs.count_batch("tag", "backbone")),
        "tag", "backbone")
    assert {tuple(r) for r in got.collect()} == {
        ("Less", "No", 1), ("Less", "?", 1), ("Moderate", "Yes", 1), ("None", "No", 2)}


def test_progress(spark, tmp_path, source):
    rows = runs.merge_progress(partials(spark, tmp_path, source, runs.progress_batch())).collect()
    assert {(r.run_id, r.total, r.results, r.done) for r in rows} == {
        ("r1", 3, 3, True), ("r2", 2, 1, False), (None, None, 1, False)}


def test_latest(spark, tmp_path, source):
    keys = ("run_id", "idx")
    stream = source.where("idx is not null")
    rows = runs.latest(
        partials(spark, tmp_path, stream, runs.latest_batch(keys, "seq", "event")), keys, "seq", "event")
    assert {tuple(r) for r in rows.collect()} == {
        ("r1", 1, 3, "result"), ("r1", 2, 4, "result"), ("r1", 3, 6, "error"), ("r2", 1, 1, "result")}


def test_running_counts(spark, tmp_path, source):
    out = str(tmp_path / "counts")
    stream = source.where("is_result")
    runs.running_counts(stream, ("tag",), out, str(tmp_path / "log")).awaitTermination()
    assert {tuple(r) for r in runs.last_counts(spark, out).select("tag", "n").collect()} == {
        ("Less", 2), ("Moderate", 1), ("None", 2)}


def test_monitor(spark, spec, tmp_path):
    folder = tmp_path / "monitor"
    rows = [(10, "flow", '{"tag": 1}'), (149, "flow", "x"), (150, "flow", "Moderate"),
            (900, "sse", None), (10_000, "sse", "moderate")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "s bigint, event string, body string").select(
            F.timestamp_seconds("s").alias("ts"), "event", "body"
        ).coalesce(1).write.mode("append").parquet(str(folder))
    batch = spark.read.parquet(str(folder))
    total = {tuple(r) for r in monitor.tally(batch, spec).collect()}
    assert total == {("flow", 3, 2), ("sse", 2, 0)}
    want = {tuple(r) for r in
            monitor.tally(monitor.windowed(batch), spec, "window_start", "event").collect()}
    assert {(r[1], r[2], r[3]) for r in want} == {
        ("flow", 2, 1), ("flow", 1, 1), ("sse", 1, 0)}
    stream = spark.readStream.schema(batch.schema).parquet(str(folder))
    q = (
        monitor.window_tally_stream(stream, spec, "1 day").writeStream.outputMode("complete")
        .format("memory").queryName("tally").option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("tally").collect()} == want


def test_upsert_stream(spark, spec, tmp_path):
    def frame(rows, order):
        given = ("project_name", "notes")
        df = spark.createDataFrame(rows, f"{order} bigint, project_name string, notes string")
        return df.select(order, *[
            F.col(c) if c in given else (F.lit(0.0) if c == "score" else F.lit("")).alias(c)
            for c in spec.sheet_headers])

    base, arriving = str(tmp_path / "base"), str(tmp_path / "in")
    frame([(2, "A", "old"), (3, "B", "old")], "row_no").write.parquet(base)
    for i, rows in enumerate(([(1, "a", "first"), (2, "C", "first")], [(1, "c", "second")])):
        frame(rows, "ord").coalesce(1).write.parquet(f"{arriving}/{i}")
    stream = (
        spark.readStream.schema(frame([(1, "a", "b")], "ord").schema)
        .option("maxFilesPerTrigger", 1).parquet(f"{arriving}/*")
    )
    out = str(tmp_path / "sheet")
    upserts.upsert_stream(spark, base, stream, out, str(tmp_path / "log"), spec).awaitTermination()
    rows = upserts.current_sheet(spark, base, out).orderBy("row_no").collect()
    assert [(r.row_no, r.project_name, r.notes) for r in rows] == [
        (2, "a", "first"), (3, "B", "old"), (4, "c", "second")]


def test_parts_are_merged_and_never_counted_twice(spark, tmp_path):
    out = str(tmp_path / "parts")
    frame = lambda n: spark.createDataFrame([("a", n)], "k string, n bigint")
    merge = lambda p: runs.merge_counts(p, "k")
    for i in range(3):
        frame(1).write.parquet(ranges.part(out, i, i))
    assert ranges.merge_levels(spark, out, merge, 2, fanout=2) is None
    ranges.merge_levels(spark, out, merge, 2, fanout=3)
    assert [f[:2] for f in ranges.current(spark, out)] == [(0, 2)]
    frame(1).write.mode("overwrite").parquet(ranges.part(out, 2, 2))  # a repeated batch
    frame(1).write.parquet(ranges.part(out, 3, 3))
    (tmp_path / "parts" / "part=4-4").mkdir()  # not finished
    assert merge(runs.read_partials(spark, out)).first().n == 4
    ranges.merge_levels(spark, out, merge, 3, fanout=2)
    assert merge(runs.read_partials(spark, out)).first().n == 4
    assert [f[:2] for f in ranges.finished(spark, out)] == [(0, 2), (0, 3), (3, 3)]
    assert [f[:2] for f in ranges.current(spark, out, before=3)] == [(0, 2)]


def test_a_merged_stream_takes_a_repeated_batch(spark, tmp_path, source):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    merge = lambda p: runs.merge_counts(p, "tag")
    start = lambda: runs.write_partials(source.where("is_result"), runs.count_batch("tag"), out, log, merge, fanout=2)
    start().awaitTermination()
    ranges.forget_commit(spark, log, 1)
    start().awaitTermination()
    assert {tuple(r) for r in merge(runs.read_partials(spark, out)).collect()} == {
        ("Less", 2), ("Moderate", 1), ("None", 2)}
    assert len(ranges.current(spark, out)) == 1


def test_levels_rewrite_each_batch_once_a_level():
    """Bytes written again over 256 batches: n log n, where one folder for all history took n * n / every."""
    for n, fanout in ((256, 4), (256, 2), (250, 3), (64, 8)):
        rewritten, open_ = 0, []
        for b in range(n):
            open_.append((b, b))
            span = ranges.span_of(b, fanout)
            inside = [f for f in open_ if f[0] > b - span]
            if span > 1:
                rewritten += sum(last - first + 1 for first, last in inside)
                open_ = [f for f in open_ if f not in inside] + [(b + 1 - span, b)]
            assert open_[0][0] == 0 and all(x[1] + 1 == y[0] for x, y in zip(open_, open_[1:]))
            assert len(open_) <= (fanout - 1) * (math.ceil(math.log(n, fanout)) + 1)
        assert rewritten <= n * math.log(n, fanout) + 1e-6


def test_merged_levels_tell_the_same(spark, tmp_path):
    out = str(tmp_path / "parts")
    merge = lambda p: runs.merge_counts(p, "k")
    for i in range(9):
        spark.createDataFrame([("a", 1 << i)], "k string, n bigint").write.parquet(ranges.part(out, i, i))
        ranges.merge_levels(spark, out, merge, i, fanout=3)
        assert merge(runs.read_partials(spark, out)).first().n == (2 << i) - 1
    assert [f[:2] for f in ranges.current(spark, out)] == [(0, 8)]


def test_latest_counts_take_back_what_they_counted(spark, tmp_path):
    """Re-verified, late and repeated results: the counts are those of the latest states."""
    out, log, folder = str(tmp_path / "out"), str(tmp_path / "log"), tmp_path / "in"
    batches = [
        [("r1", 1, 5, "Less"), ("r1", 2, 6, "None"), ("r2", 1, 1, "Less"), (None, None, None, "None")],
        [("r1", 1, 9, "Moderate"), ("r1", 1, 7, "Less"), ("r2", 1, 1, "Less")],  # a later one, and one again
        [("r1", 1, 8, "None"), ("r3", 1, 2, "Less"), ("r1", 2, 10, "None"), (None, 4, 1, "None")],  # a late one
        [("r1", 2, 11, "Moderate"), ("r2", 1, 3, "Moderate")],
    ]
    ddl = "run_id string, idx int, seq bigint, tag string"
    rows = [r for b in batches for r in b]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, ddl).coalesce(1).write.parquet(str(folder / str(i)))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    facets = lambda s: s.select(F.lit("tag").alias("facet"), F.col("tag").alias("value"))
    start = lambda: runs.latest_counts(spark, stream, ("run_id", "idx"), "seq", "tag string", facets, out, log, fanout=2)
    start().awaitTermination()
    last = {}
    for run, idx, seq, tag in rows:
        if run is not None and seq > last.get((run, idx), (-1, ""))[0]:
            last[run, idx] = (seq, tag)
    want = {}
    for tag in [t for _, t in last.values()] + [r[3] for r in rows if r[0] is None]:
        want[tag] = want.get(tag, 0) + 1
    got = lambda: {r.value: r.n for r in runs.read_latest_counts(spark, out).collect()}
    assert got() == want
    ranges.forget_commit(spark, log, len(batches) - 1)
    start().awaitTermination()
    assert got() == want


def test_an_event_delivered_twice_ends_its_item_once(spark):
    ddl = "run_id string, idx int, total int, is_result boolean"
    first = [("r1", 1, 3, True), ("r1", 1, 3, True), ("r1", 40_000, 3, True), ("r2", None, 2, False), ("r1", 2, 3, False)]
    again = [("r1", 1, 3, True), ("r1", 2, 3, True), ("r2", 0, 2, True), (None, None, None, True)]
    reduce_batch = runs.ended_items()
    parts = [reduce_batch(spark.createDataFrame(b, ddl)) for b in (first, again, again[:3])]
    merged = runs.merge_ended(parts[0].unionByName(parts[1])).unionByName(parts[2])
    assert {tuple(r) for r in runs.exact_progress(merged).select("run_id", "total", "results", "done").collect()} == {
        ("r1", 3, 3, True), ("r2", 2, 1, False), (None, None, 1, False)}
