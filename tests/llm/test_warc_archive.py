import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from usemeter.llm import warc_archive
from usemeter.llm.warc_archive import archived, export_segments, read_archive, write_archive
from usemeter.session import scratch_dir

DDL = "page_id long, url string, html string"
LONG = "<p>é漢 " + "x" * 200


def pages(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    for name in ("digest", "payload", "head", "first_id", "f", "refers_to"):  # names used inside
        df = df.withColumn(name, F.lit(1))
    return df


ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
    (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7\r\nWARC-Type: x", LONG + "!"), (None, "http://a/8", LONG),
    (None, "http://a/9", LONG + "?"), (8, "http://b/%0A: x", "y" * 99), (10, "http://b/2", "y" * 99), (11, "http://b/3", "z" * 100),
    (12, "http://b/4", "z" * 100), (13, "http://c", "w" * 3_000_000), (14, "http://c", "w" * 3_000_000),
]


def brute(rows, least=100):
    out, first = [], {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = len(data) >= least and to is not None and i != to
        out.append((i, hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None, data))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in df.collect()), key=str)


def test_records_equal_the_pages(spark):
    assert got(archived(pages(spark, ROWS))) == brute(ROWS)
    assert got(archived(pages(spark, ROWS), least=1)) == brute(ROWS, 1)


def test_repeated_rows_stay(spark):
    rows = [(1, "u", LONG)] * 3 + [(2, "u", LONG)] * 2
    found = got(archived(pages(spark, rows)))
    assert found == brute(rows) and [r[2] for r in found].count("response") == 3


def test_no_rows(spark):
    assert archived(pages(spark, ROWS).limit(0)).count() == 0


def test_payloads_are_stored_once_and_heads_apart(spark):
    path = scratch_dir(spark, "warc-test")
    write_archive(pages(spark, ROWS), path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({(r[2] or "") for r in ROWS})
    assert spark.read.parquet(f"{path}/records").columns == ["digest", "head"]
    urls = {r.page_id: r.url for r in read_archive(spark, path).collect()}
    assert urls[8] == "http://b/%0A: x" and urls[7] == "http://a/7%0D%0AWARC-Type: x" and urls[9] is None


def test_records_are_whole_warc_records(spark):
    path = scratch_dir(spark, "warc-segments")
    records = archived(pages(spark, ROWS))
    export_segments(records, path, segment=1000)
    want = {}
    for r in records.collect():
        want[bytes(r.record)] = r
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        body = rest[:-4].partition(b"\r\n\r\n")[2]
        assert body == (bytes(r.payload) if r.record_type == "response" else b"")
        assert (b"WARC-Refers-To" in fields) == (r.record_type == "revisit")
    ids = {f.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for f in want if b"WARC-Type: response" in f}
    refs = {f.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for f in want if b"WARC-Type: revisit" in f}
    assert refs and refs <= ids
    files = spark.read.parquet(path).collect()
    assert len(files) > 1 and sum(f.n_records for f in files) == len(ROWS)
    members = []
    for f in files:
        data = io.BytesIO(f.payload)
        members.append(gzip.GzipFile(fileobj=data).read())
    assert sorted(b"".join(members)) == sorted(b"".join(bytes(r.record) for r in records.collect()))


def test_damage_stops_the_read(spark):
    path, bad = scratch_dir(spark, "warc-whole"), scratch_dir(spark, "warc-damaged")
    write_archive(pages(spark, ROWS), path)
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, bad).collect()
    payloads.limit(0).write.mode("overwrite").parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="no payload"):
        read_archive(spark, bad).collect()


def test_two_contents_under_one_digest_stop_the_write(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(warc_archive.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 0))
    with pytest.raises(Exception, match="different payloads"):
        write_archive(pages(spark, ROWS), scratch_dir(spark, "warc-clash"))
