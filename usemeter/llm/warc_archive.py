"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart.

An archive is a folder with two Parquet tables::

    payloads   digest, first_id, payload    one row per SHA-256 of a payload
    records    digest, head                 one row per page: the record's header bytes, to the last one
                                            before the payload (WARC fields, blank line, HTTP fields, blank line)

Writing verifies digests: rows of one digest are reduced to the set of their byte strings, so a second
content under the same digest stops the write.  Reading hashes each stored payload again, joins it to the
heads that name it, and gives whole records: a response is ``head + payload + CRLF CRLF``, a revisit has no
payload of its own and finds it through the digest.  All that a record says (id, type, url, what it refers
to) is read from its head.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usemeter.llm.common import record_batch, scratch, small_batches

LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
SEGMENT = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEGMENT = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_records", pa.int64()), ("payload", pa.binary())])


def _uuid(page_id: Column, digest: Column) -> Column:
    """A record id that follows from the page's id and its content."""
    h = F.sha2(F.concat_ws("|", F.lit("page"), page_id.cast("string"), digest).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where there is no value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _one_line(url: Column) -> Column:
    """``url`` with its control characters percent-encoded: they would end the header line."""
    escaped = url
    for code in (*range(0x20), 0x7F):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.rlike(url, F.lit(r"[\x00-\x1F\x7F]")), escaped).otherwise(url)


def _heads(records: DataFrame, date: str) -> DataFrame:
    """``digest, head`` of ``page_id, url, digest, n_bytes, refers_to``."""
    n = F.col("n_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", n), F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length(http).cast("long") + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _uuid(F.col("page_id"), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _one_line(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _field("WARC-Refers-To", F.when(revisit, _uuid(F.col("refers_to"), F.col("digest")))),
        _field("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _field("X-Page-Id", F.col("page_id").cast("string")),
        _field("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"), http,
    )
    return records.select("digest", head.cast("binary").alias("head"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = DATE, key: str = "page_id", html: str = "html") -> None:
    """A WARC record for every row of ``pages``, below ``path``.

    Of records with equal payloads of at least ``least`` bytes that of the smallest page id is a response, the
    others revisit it; shorter payloads are all responses, their bytes are stored once all the same.  A null text
    is an empty payload, a null url leaves its field out.  Rows that share the smallest id and the payload are all
    responses (the same record, kept as often as it comes).  A row without an id is never referred to: it revisits
    the smallest id there is, or is a response where its payload has none.  An empty table gives an empty archive.

    Copies collapse in their own task (a set of byte strings a digest), so a payload's copies never meet in one
    task; the first ids come back through a join of two stored tables, which Spark splits where a digest is hot.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    source = source.withColumn("digest", F.sha2("payload", 256))
    clash = F.raise_error(F.concat(F.lit("different payloads with the digest "), "digest"))
    payloads = source.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.collect_set("payload").alias("contents")).select(
        "digest", "first_id", F.when(F.size("contents") == 1, F.col("contents")[0]).otherwise(clash.cast("binary")).alias("payload")
    )
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = spark.read.schema("digest string, first_id long").parquet(f"{path}/payloads")
    narrow = source.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"))
    revisits = (F.col("n_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = narrow.join(first, "digest").withColumn("refers_to", F.when(revisits, F.col("first_id")))
    _heads(records, date).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload, record``: the records of an archive, whole.

    ``payload`` is the full one for revisits as well.  A stored payload that does not hash to its digest, or a
    record whose payload is missing, stops the read.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")
    payloads = stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(damaged).alias("payload"))
    records = spark.read.schema("digest string, head binary").parquet(f"{path}/records")
    text = F.decode("head", "UTF-8")
    fields = F.str_to_map(F.substring_index(text, "\r\n\r\n", 1), F.lit("\r\n"), F.lit(": "))
    lost = F.raise_error(F.concat(F.lit("no payload "), "digest")).cast("binary")
    response = F.col("f")["WARC-Type"] == "response"
    end = F.lit("\r\n\r\n").cast("binary")
    whole = F.when(response, F.concat("head", "payload", end)).otherwise(F.concat("head", end))
    return (
        records.join(payloads, "digest", "left")
        .select("head", fields.alias("f"), F.coalesce("payload", lost).alias("payload"))
        .select(
            F.col("f")["X-Page-Id"].cast("long").alias("page_id"), F.col("f")["WARC-Target-URI"].alias("url"),
            F.col("f")["WARC-Type"].alias("record_type"), F.col("f")["X-Refers-To-Page-Id"].cast("long").alias("refers_to"),
            F.substring_index(F.col("f")["WARC-Payload-Digest"], ":", -1).alias("payload_digest"), "payload", whole.alias("record"),
        )
    )


def export_segments(records: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write ``record`` of ``records`` as WARC files, each record a gzip member of its own.

    A file is a row (``part, file, n_records, payload``) of a Parquet table, closed once it holds ``segment``
    bytes, so any store and commit protocol will do.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, members, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for record in batch.column(0):
                members.append(gzip.compress(record.as_py(), mtime=0))
                size += len(members[-1])
                if size >= segment:
                    yield record_batch(_SEGMENT, [part], [file], [len(members)], [b"".join(members)])
                    file, members, size = file + 1, [], 0
        if members:
            yield record_batch(_SEGMENT, [part], [file], [len(members)], [b"".join(members)])

    small_batches(records.sparkSession)
    records.select("record").mapInArrow(pack, "part int, file int, n_records long, payload binary").write.parquet(path)


def archived(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT, key: str = "page_id", html: str = "html") -> DataFrame:
    """Write ``pages`` as an archive (in the shared folder, unless ``path`` is given) and read its records back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, least, key=key, html=html)
    return read_archive(spark, path)
