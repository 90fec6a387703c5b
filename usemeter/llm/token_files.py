"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents.  Its ids are cut into blocks of ``BLOCK``; a block keeps its minimum, the
differences packed at the width that ``PERCENTILE`` of them need, and an exception list (place, high bits)
for the others.  An index holds where each block's words and exceptions start, so any block reads alone.

A file is one row of a Parquet table: Spark's commit protocol makes writing safe against lost executors on
any store, and the payload is the format below (all little-endian)::

    8 bytes  magic "PFORIDS1"
    5 x u64  documents, ids, blocks, packed words, exceptions
    i64[documents]    doc ids           u8[documents]   1 where the id is null
    u64[documents]    ids of each document, its end id included
    u32[blocks]       minimum           u8[blocks]      width
    u64[blocks + 1]   first word        u64[blocks + 1] first exception
    u64[words]        packed differences, block by block, ``2 * width`` words each
    u8[exceptions]    place in the block                u32[exceptions] high bits
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usemeter.llm.bpe import encoder
from usemeter.llm.common import narrow, partitions, record_batch
from usemeter.session import scratch_dir

MAGIC = b"PFORIDS1"
BLOCK = 128
PERCENTILE = 90
_FILE = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_READ = pa.schema(
    [("part", pa.int32()), ("file", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(minimum, width, first_word, first_exception, words, places, highs)`` of ``ids``."""
    n_blocks = -(-len(ids) // BLOCK)
    kind = np.uint16 if len(ids) and ids.max() < 1 << 16 else np.uint32  # half the bytes to go through
    padded = np.empty(n_blocks * BLOCK, kind)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[(n_blocks - 1) * BLOCK :].min() if len(ids) else 0
    rows = padded.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1, initial=np.iinfo(kind).max)
    rows = rows - low[:, None]
    at_percentile = -(-BLOCK * PERCENTILE // 100) - 1
    width = _widths(np.partition(rows, at_percentile, axis=1)[:, at_percentile])
    bits = np.iinfo(kind).bits
    patched = rows > np.where(width < bits, (1 << np.minimum(width, bits - 1).astype(np.int64)) - 1, np.iinfo(kind).max).astype(kind)[:, None]
    block, place = np.nonzero(patched)
    highs = rows[block, place].astype(np.uint32) >> width[block]
    first_exception = np.r_[0, np.cumsum(patched.sum(axis=1))].astype(np.uint64)
    first_word = np.r_[0, np.cumsum(2 * width.astype(np.int64))].astype(np.uint64)
    words = np.zeros(int(first_word[-1]), np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        at = np.flatnonzero(width == w)
        value = np.ascontiguousarray((rows[at] & kind((1 << int(w)) - 1)).T).astype(np.uint64)
        packed = np.zeros((2 * int(w), len(at)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * int(w), 64)
            packed[word] |= value[i] << np.uint64(shift)
            if shift + int(w) > 64:
                packed[word + 1] |= value[i] >> np.uint64(64 - shift)
        words[(first_word[at].astype(np.int64)[:, None] + np.arange(2 * int(w)))] = packed.T
    return low.astype(np.uint32), width, first_word, first_exception, words, place.astype(np.uint8), highs.astype(np.uint32)


def unpack_blocks(count: int, low, width, first_word, first_exception, words, places, highs) -> np.ndarray:
    rows = np.zeros((len(low), BLOCK), np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        at, mask = np.flatnonzero(width == w), np.uint64((1 << int(w)) - 1)
        packed = np.ascontiguousarray(words[first_word[at].astype(np.int64)[:, None] + np.arange(2 * int(w))].T)
        value = np.empty((BLOCK, len(at)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * int(w), 64)
            value[i] = packed[word] >> np.uint64(shift)
            if shift + int(w) > 64:
                value[i] |= packed[word + 1] << np.uint64(64 - shift)
        rows[at] = (value & mask).T
    block = np.repeat(np.arange(len(low)), np.diff(first_exception.astype(np.int64)))
    rows[block, places] |= highs.astype(np.uint64) << width[block].astype(np.uint64)
    return (rows + low.astype(np.uint64)[:, None]).reshape(-1)[:count].astype(np.uint32)


def write_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a file with these documents."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    low, width, first_word, first_exception, words, places, highs = pack_blocks(flat)
    lengths = np.array([len(x) for x in ids], "<u8")
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<5Q", len(ids), len(flat), len(low), len(words), len(highs))
    return head + b"".join(x.tobytes() for x in (numbers, nulls, lengths, low, width, first_word, first_exception, words, places, highs))


def read_file(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a file: their ids and their tokens."""
    if payload[:8] != MAGIC:
        raise ValueError("not a file of token blocks")
    n_docs, count, n_blocks, n_words, n_high = struct.unpack_from("<5Q", payload, 8)
    at, found = 48, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_blocks), ("u1", n_blocks), ("<u8", n_blocks + 1), ("<u8", n_blocks + 1), ("<u8", n_words), ("u1", n_high), ("<u4", n_high)):
        found.append(np.frombuffer(payload, kind, n, at))
        at += found[-1].nbytes
    numbers, nulls, lengths, *blocks = found
    ids = unpack_blocks(count, *blocks)
    ends = np.cumsum(lengths.astype(np.int64))
    return [None if z else int(d) for d, z in zip(numbers, nulls)], np.split(ids, ends[:-1]) if n_docs else []


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, file_tokens: int = 1 << 20, text: str = "text", key: str = "doc_id"
) -> None:
    """Encode every text of ``docs``, append ``end_id``, and write files below ``path`` in ascending order of ``key``.

    Texts are dealt by ranges of the id and sorted inside each range, so ``(part, file)`` is the global order;
    a file takes whole documents until it has ``file_tokens`` ids (one very long document makes one larger
    file).  Null ids come first; a null text is empty and gives the end id alone; rows with the same id are
    ordered by their text's hash and all kept; an empty table writes no file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part, number = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        numbers, ids, size = [], [], 0

        def out():
            return record_batch(_FILE, [part], [number], [len(ids)], [size], [write_file(numbers, ids)])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for number_of_doc, found in zip(batch.column("id").to_pylist(), encode_all(texts), strict=True):
                numbers.append(number_of_doc)
                ids.append(np.concatenate([found, end], dtype=np.uint32))
                size += len(ids[-1])
                if size >= file_tokens:
                    yield out()
                    number, numbers, ids, size = number + 1, [], [], 0
        if ids:
            yield out()

    n = partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = narrow(docs, text, key).repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    ordered.mapInArrow(encode, "part int, file int, n_docs long, n_tokens long, payload binary").write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of the files below ``path``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, payload in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), batch.column("payload"), strict=True):
                numbers, ids = read_file(payload.as_py())
                n = len(ids)
                lengths = np.array([len(x) for x in ids], np.int64)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield record_batch(_READ, [part] * n, [file] * n, range(n), numbers, np.cumsum(lengths) - lengths, lengths, crc)

    files = spark.read.parquet(path)
    docs = files.select("part", "file", "payload").mapInArrow(
        decode, "part int, file int, place long, doc_id long, before long, n_tokens long, ids_crc32 long"
    )
    # Offsets in two steps: the parts are few, a part's files are counted on their own.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_file = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "file", before_file.alias("in_part")).join(parts.select("part", before_part.alias("of_part")), "part")
    return docs.join(starts, ["part", "file"]).select("doc_id", (F.col("of_part") + F.col("in_part") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``docs`` as token files (in the shared folder, unless ``path`` is given) and describe them as read back."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id, text=text, key=key)
    return read_token_files(spark, path)
