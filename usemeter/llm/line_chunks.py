"""Removal of repeated multi-line chunks whose boundaries the content itself chooses.

A rolling hash over the hashes of the last few lines ends a chunk where its remainder says so; lines of
``long_words`` words or more are chunks of their own.  Inserted or deleted lines move no later boundary.  Each
length of the rolling window and each of ``divisor`` remainders gives one chunking, so a boundary that one
misses another has.  Besides, from each line and to
each line the shortest run of lines that reaches ``long_words`` words is a chunk, so a repeated passage of that many
words goes in full, wherever boundaries fall.  A chunk counts if it
has two lines with words, or is one long line.  Of chunks with the same 128-bit hash the first in order of
(id, text hash, line) stays; the others go once their bytes have been compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usemeter.llm.common import keep, releasing, small_batches

_CHUNK = pa.schema([("no_id", pa.bool_()), ("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary())])
_DOC = ["no_id", "id", "tie"]
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _runs(lines: list[str], words: list[int], long_words: int) -> Iterator[tuple[int, int]]:
    """From each line with words the shortest run that reaches ``long_words`` words, and to each the shortest such run.

    Together they cover every line with words of any passage of so many words, wherever it starts and ends.
    """
    at = [i for i, w in enumerate(words) if w]
    total = [0]
    for i in at:
        total.append(total[-1] + (words[i] if words[i] > 1 else len(lines[i].encode().split())))
    stop = 0
    for start in range(len(at)):
        while stop < len(at) and total[stop] - total[start] < long_words:
            stop += 1
        if total[stop] - total[start] < long_words:
            break
        yield at[start], at[stop - 1] + 1
    start = 0
    for stop in range(1, len(at) + 1):
        while total[stop] - total[start + 1] >= long_words:
            start += 1
        if total[stop] - total[start] >= long_words:
            yield at[start], at[stop - 1] + 1


def chunk_spans(lines: list[str], windows: Sequence[int] = (1, 2, 3), divisor: int = 2, long_words: int = 50) -> list[tuple[int, int]]:
    """``(start, stop)`` of the chunks of all chunkings that count."""
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    words = [len(line.encode().split()) if len(line) >= 2 * long_words else (0 if line.isspace() or not line else 1) for line in lines]
    is_long = [w >= long_words for w in words]
    spans = set()
    for window in windows:
        ends: list[list[int]] = [[] for _ in range(divisor)]
        rolling, out = 0, pow(_BASE, window, _MASK + 1)
        for i, h in enumerate(hashes):
            rolling = (rolling * _BASE + h) & _MASK
            if i >= window:
                rolling = (rolling - hashes[i - window] * out) & _MASK
            if i + 1 == len(lines) or is_long[i] or is_long[i + 1]:
                for e in ends:
                    e.append(i + 1)
            else:
                ends[(((rolling ^ (rolling >> 31)) * 0xC2B2AE3D27D4EB4F & _MASK) >> 40) % divisor].append(i + 1)
        spans.update(span for e in ends for span in zip([0, *e], e))
    spans.update(_runs(lines, words, long_words))
    return sorted(s for s in spans if sum(map(bool, words[s[0] : s[1]])) > 1 or (s[1] - s[0] == 1 and is_long[s[0]]))


def _find(windows: Sequence[int], divisor: int, long_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no_id, i, tie, text in zip(*(batch.column(c).to_pylist() for c in ("no_id", "id", "tie", "text"))):
                lines = text.split("\n")
                for start, stop in chunk_spans(lines, windows, divisor, long_words):
                    rows.append((no_id, i, tie, start, stop, xxhash.xxh3_128_digest("\n".join(lines[start:stop]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CHUNK)], schema=_CHUNK)

    return find


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def repeated_chunks(rows: DataFrame, windows: Sequence[int], divisor: int, long_words: int) -> DataFrame:
    """The lines to drop: ``(no_id, id, tie, drop array<int>)`` for ``rows (no_id, id, tie, text)``."""
    found = rows.mapInArrow(releasing(_find(windows, divisor, long_words)), "no_id boolean, id long, tie long, start int, stop int, digest binary")
    # Rows that repeat entirely are one document: their chunks have one place, so all of them are first or none.
    chunks = keep(found, "chunks")
    place = F.struct("no_id", "id", "tie", "start")
    first = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1")
    repeats = chunks.join(first.drop("m"), "digest").withColumn("is_first", place == F.col("first"))
    per_doc = repeats.groupBy(*_DOC).agg(F.collect_list(F.struct("digest", "start", "stop", "is_first")).alias("found"))
    cut = F.flatten(
        F.transform(
            F.array(_lines("text")),
            lambda lines: F.transform(
                F.col("found"),
                lambda c: F.struct(c["digest"].alias("digest"), c["start"].alias("start"), c["stop"].alias("stop"), c["is_first"].alias("is_first"), F.array_join(F.slice(lines, c["start"] + 1, c["stop"] - c["start"]), "\n").alias("chunk")),
            ),
        )
    )
    texts = keep(rows.join(per_doc, _DOC).select(*_DOC, F.explode(cut).alias("c")).select(*_DOC, "c.*"), "chunk-texts")
    kept = texts.where("is_first").groupBy("digest").agg(F.min("chunk").alias("kept"))
    same = texts.where("not is_first").join(kept, "digest").where("chunk = kept")
    return same.groupBy(*_DOC).agg(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, stop - 1)")))).alias("drop"))


def _kept(rows: DataFrame, windows: Sequence[int], divisor: int, long_words: int) -> DataFrame:
    """``rows`` with ``drop`` (null: nothing), and ``text`` without the lines in it."""
    drop = repeated_chunks(rows.select(*_DOC, "text"), windows, divisor, long_words)
    kept = F.array_join(F.expr("filter(split(text, '\\n', -1), (line, i) -> not array_contains(drop, i))"), "\n")
    joined = rows.join(drop, _DOC, "left")
    return joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept))


def _keyed(docs: DataFrame, text: str, key: str, *others: Column) -> DataFrame:
    small_batches(docs.sparkSession)
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{key}`").isNull().alias("no_id"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(source).alias("tie"), source.alias("text"), *others,
    )


def drop_repeated_chunks(docs: DataFrame, windows: Sequence[int] = (1, 2, 3), divisor: int = 2, long_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)`` of every row: its text without the chunks found earlier elsewhere.

    Every removed line stays in the first document that has its chunk, or in an earlier one.  Null and empty
    texts come back empty; null ids stand last in the order; rows equal in id and text are one document and
    come back alike; an empty table gives none; other columns are not looked at.  Lines end at line feeds.
    """
    return _kept(_keyed(docs, text, key), windows, divisor, long_words).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.size(_lines("text")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"),
        F.col("kept").alias("text"),
    )


def without_repeats(docs: DataFrame, windows: Sequence[int] = (1, 2, 3), divisor: int = 2, long_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns and ``text`` as ``drop_repeated_chunks`` leaves it; null texts stay null."""
    others = F.struct(F.col(f"`{text}`").isNull().alias("_null"), *(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    kept = _kept(_keyed(docs, text, key, others), windows, divisor, long_words)
    new = F.when(~F.col("row._null"), F.col("kept"))
    return kept.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
