"""Sessions of a stream against a batch computation over the same events."""

import random

import pytest

from usemeter.streaming.sessions import STATE_STORE, listening_sessions

DDL = "user string, s double, event string, body string"


def batch_sessions(rows, seconds=150):
    """Greedy: a session opens with the first event that is in none, and takes all up to its end."""
    out = {}
    for user in {r[0] for r in rows}:
        end = None
        for _, s, event, body in sorted((r for r in rows if r[0] == user), key=lambda r: r[1]):
            if end is None or s >= end:
                start, end = s, s + seconds
            n, v = out.get((user, start, event), (0, 0))
            out[user, start, event] = (n + 1, v + ("Moderate" in (body or "")))
    return out


@pytest.fixture
def rocks(spark):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in STATE_STORE:
        spark.conf.unset(k)


def run(spark, spec, tmp_path, batches, late):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).selectExpr("user", "timestamp_millis(cast(s * 1000 as bigint)) AS ts", "event", "body").coalesce(1).write.parquet(str(folder / str(i)))
    stream = spark.readStream.schema("user string, ts timestamp, event string, body string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = (
        listening_sessions(stream, spec, "user", late).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).selectExpr("key", "unix_millis(session_start) / 1000 AS s", "event", "n", "verdicts", "late").collect()


def test_sessions_equal_a_batch(spark, spec, rocks, tmp_path):
    """Events out of order within what the watermark allows: the same sessions as over all at once."""
    rnd = random.Random(3)
    rows = [(f"u{rnd.randint(0, 4)}", round(rnd.uniform(0, 3000), 3), rnd.choice(["flow", "sse"]), rnd.choice(["Moderate", "x", None])) for _ in range(300)]
    arriving = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 200))
    batches = [arriving[i : i + 75] for i in range(0, 300, 75)] + [[("end", 100_000.0, "flow", None)]]
    found = run(spark, spec, tmp_path, batches, "300 seconds")
    assert not any(r.late for r in found)
    assert {(r.key, r.s, r.event): (r.n, r.verdicts) for r in found if r.key != "end"} == batch_sessions(rows)


def test_late_events_are_accounted_for(spark, spec, rocks, tmp_path):
    batches = [
        [("u", 1000.0, "flow", "Moderate"), ("u", 1149.999, "flow", None)], [("v", 5000.0, "sse", None)], [("v", 5001.0, "sse", None)],
        [("u", 1010.0, "flow", "Moderate"), ("u", 1150.0, "sse", None)], [("v", 100_000.0, "sse", None)],
    ]
    found = {(r.key, r.s, r.event, r.late): (r.n, r.verdicts) for r in run(spark, spec, tmp_path, batches, "10 seconds")}
    assert found[("u", 1000.0, "flow", False)] == (2, 1)
    told = sum(n for (k, *_), (n, _) in found.items() if k == "u")
    assert told == 4 and found[("u", None, "flow", True)] == (1, 1)
