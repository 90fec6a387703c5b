"""Hosts of more pages than one task takes: substrings are counted in shards, and the counts added up.

Pages are dealt to shards by their content, so copies meet in one.  Near copies are found over the whole host by
the bands of their signatures, and their classes are sent to the shards.  Each shard's suffix array gives its distinct substrings with
the number of contents they stand on (of a class, which several shards may hold, the substrings by name); buckets
of substrings, over all shards, add these up and send back the totals that can make a block boilerplate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.llm.common import bounds, from_planes, keep, planes
from usemeter.llm.graph import components
from usemeter.llm.html_text import (
    _SLOTS, MIN_PAGES, MIN_TOKENS, NEAR, TEXT_DDL, Hashes, Packages, bands_of, columns_of, content_of, covering, gram_hashes,
    main_text, owned, packages, parse, ranks, signature, text_rows, unpacked,
)

#: Tokens of one shard, by the estimate that ``HOST_TOKENS`` goes by.
SHARD_TOKENS = 1_000_000
#: Pages of one shard that one task judges; with more copies the shard is judged by several.
JUDGED_PAGES = 10_000

_READ = pa.schema([("host", pa.string()), ("shards", pa.int32()), ("shard", pa.int32()), ("pages", pa.binary())])
_READ_DDL = "host string, shards int, shard int, pages binary"
_COUNTED = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("grams", "counts", "shared", "classes", "roots")]])
_COUNTED_DDL = "host string, shard int, bucket int, grams binary, counts binary, shared binary, classes binary, roots binary"


def _sent(grams: np.ndarray) -> bytes:
    """Sorted substrings by the gaps between them, of which only the low bytes are not zero."""
    return planes(np.diff(grams, prepend=np.uint64(0)))


def _received(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _read(distinct: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parsed pages, packed by shard, with the name of their content; if ``distinct``, a task leaves out contents that it had."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), Packages()
        for batch in batches:
            ready = []
            for page_id, url, html, host, shards in columns_of(batch, "page_id", "url", "html", "host", "shards"):
                page = parse(html)
                content = content_of(host, page)
                if distinct:
                    if content in seen:
                        continue
                    if len(seen) >= 1_000_000:  # contents that come again do no harm
                        seen.clear()
                    seen.add(content)
                row = (content,) if distinct else (content, page_id, url)
                ready += held.add((host, shards, content % shards), row, page)
            yield packages(_READ, ready)
        yield packages(_READ, list(held.rest()))

    return read


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of each page with its signature and bands; a page without tokens has none."""
    hashes = Hashes()
    for batch in batches:
        contents, slots, bands = [], [], []
        for html, host in columns_of(batch, "html", "host"):
            page = parse(html)
            tokens = hashes.of(page)
            contents.append(content_of(host, page))
            own = signature(gram_hashes(tokens, contents[-1])) if len(tokens) else None
            slots.append([] if own is None else own.view(np.int16))
            bands.append([] if own is None else bands_of(own))
        arrays = [batch.column("host"), batch.column("shards"), pa.array(contents, pa.int64()), pa.array(slots, pa.list_(pa.int16())), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "shards", "content", "slots", "bands"])


def _near_classes(contents: DataFrame) -> DataFrame:
    """``(node, root)`` of all contents that have near copies, as ``near_roots`` has them."""
    banded = contents.select("host", "content", F.posexplode("bands").alias("k", "band")).select("content", F.xxhash64("host", "k", "band").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("content").alias("hub"), F.max("content").alias("last")).where("hub <> last").drop("last")
    pairs = banded.join(hubs, "band").where("content <> hub").select("content", "hub").distinct()
    own, its = contents.select("content", "slots"), contents.select(F.col("content").alias("hub"), F.col("slots").alias("hub_slots"))
    equal = F.aggregate(F.zip_with("slots", "hub_slots", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    alike = pairs.join(own, "content").join(its, "hub").where(equal >= NEAR * _SLOTS)
    return keep(components(alike.select(F.col("content").alias("a"), F.col("hub").alias("b"))), "classes")


def _by_bucket(buckets: int, grams: np.ndarray, *others: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The arrays cut where the sorted grams go over to the next of ``buckets`` ranges."""
    bucket = (grams >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(1, buckets, dtype=np.uint64))
    return list(zip(*(np.split(a, cuts) for a in (grams, *others))))


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct substrings of each shard, by bucket: with their numbers of contents, and those of classes."""
    hashes, shard, classes, streams = Hashes(), None, {}, {}

    def named(found, roots):
        names, place = np.unique(roots, return_inverse=True)
        return _sent(found), planes(place.astype(np.uint32)), planes(names)

    def out():
        host, number, shards = shard
        contents, tokens = np.array(list(streams), np.int64), list(streams.values())
        owners = np.array([classes.get(c, c) for c in streams], np.int64)
        shared = np.array([c in classes for c in streams], bool)
        rank, stops = ranks(tokens, MIN_TOKENS)
        lengths = np.array([len(t) for t in tokens], np.int64)
        of = np.repeat(np.arange(len(tokens)), lengths + 1)
        grams = np.concatenate([np.r_[gram_hashes(t, int(c)), np.uint64(0)] for t, c in zip(tokens, contents)])
        once = owned(rank, owners[of])
        once = once[stops[of[once]] - once >= MIN_TOKENS]  # the others are on one content each
        in_class = shared[of[once]]
        single = once[~in_class]
        runs = bounds(rank[single])
        found, numbers = grams[single[runs[:-1]]], np.diff(runs).astype(np.uint32)
        order = np.argsort(found)
        alone = _by_bucket(shards, found[order], numbers[order])
        found, roots = grams[once[in_class]], owners[of[once[in_class]]]
        order = np.argsort(found)
        together = _by_bucket(shards, found[order], roots[order])
        rows = [(host, number, b, _sent(x[0]), planes(x[1]), *named(*y)) for b, (x, y) in enumerate(zip(alone, together)) if len(x[0]) or len(y[0])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTED)], schema=_COUNTED)

    for batch in rows:
        for host, number, shards, content, root, pages in columns_of(batch, "host", "shard", "shards", "content", "root", "pages"):
            if shard is not None and shard[:2] != (host, number):
                if streams:
                    yield out()
                classes, streams = {}, {}
            shard = (host, number, shards)
            if pages is None:
                classes[content] = root
                continue
            for (content,), page in unpacked(pages):
                if content not in streams:
                    streams[content] = hashes.of(page)
    if streams:
        yield out()


def _add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each shard its substrings that stand on ``MIN_PAGES`` contents of the host or more, with their number."""
    bucket, run = None, []

    def out():
        own = [(_received(g), from_planes(n, np.uint32), _received(k), from_planes(r, np.int64)[from_planes(c, np.uint32)]) for _, g, n, k, c, r in run]
        shared, roots = np.concatenate([o[2] for o in own]), np.concatenate([o[3] for o in own])
        once = owned(np.unique(shared, return_inverse=True)[1], roots)  # a class counts once, whatever shards it is in
        grams, place = np.unique(np.concatenate([*[o[0] for o in own], shared[once]]), return_inverse=True)
        numbers = np.concatenate([*[o[1] for o in own], np.ones(len(once), np.uint32)])
        totals = np.bincount(place, numbers, len(grams)).astype(np.uint32)
        grams, totals = grams[totals >= MIN_PAGES], totals[totals >= MIN_PAGES]
        hosts, shards, asked, answers = [], [], [], []
        for (shard, *_), (alone, _, together, _) in zip(run, own):
            wanted = np.isin(grams, alone) | np.isin(grams, together)
            if wanted.any():
                hosts.append(bucket[0])
                shards.append(shard)
                asked.append(_sent(grams[wanted]))
                answers.append(planes(totals[wanted]))
        arrays = [pa.array(hosts, pa.string()), pa.array(shards, pa.int32()), pa.array(asked, pa.binary()), pa.array(answers, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["host", "shard", "grams", "totals"])

    for batch in rows:
        for host, number, *row in columns_of(batch, "host", "bucket", "shard", "grams", "counts", "shared", "classes", "roots"):
            if run and bucket != (host, number):
                yield out()
                run = []
            bucket = (host, number)
            run.append(row)
    if run:
        yield out()


def _judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of each shard behind the totals of its substrings."""
    hashes, part, contents, sent, known = Hashes(), None, 0, [], None
    for batch in rows:
        pages, texts = [], []
        for *its_part, kind, number, grams, totals, data in columns_of(batch, "host", "shard", "salt", "kind", "contents", "grams", "totals", "pages"):
            if part != its_part:
                part, sent, known = its_part, [], None
            if kind == 0:
                contents = number
            elif kind == 1:
                sent.append((_received(grams), from_planes(totals, np.uint32).astype(np.int64)))
            else:
                if known is None:
                    known = [np.concatenate(x) for x in zip(*sent)] if sent else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
                    order = np.argsort(known[0])
                    known = [x[order] for x in known]
                for (content, page_id, url), page in unpacked(data):
                    own = gram_hashes(hashes.of(page), content)
                    counts = np.ones(len(own), np.int64)
                    if len(known[0]):
                        at = np.minimum(np.searchsorted(known[0], own), len(known[0]) - 1)
                        counts = np.where(known[0][at] == own, known[1][at], 1)
                    counts[max(len(own) - MIN_TOKENS + 1, 0) :] = 1
                    pages.append((page_id, url))
                    texts.append(main_text(page, covering(counts), contents))
                if len(pages) >= 1000:
                    yield text_rows(pages, texts)
                    pages, texts = [], []
        yield text_rows(pages, texts)


def large_host_texts(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of the pages ``rows`` of the hosts ``large``, which has their ``tokens``."""
    shards = F.ceil(F.col("tokens") / SHARD_TOKENS).cast("int")
    dealt = rows.join(F.broadcast(large.select("host", shards.alias("shards"))), "host").select("page_id", "url", "html", "host", "shards")
    shard = F.expr("cast(pmod(content, shards) as int)").alias("shard")
    signed = dealt.mapInArrow(_sign, "host string, shards int, content long, slots array<smallint>, bands array<long>")
    contents = keep(
        signed.groupBy("host", "shards", "content").agg(F.count("*").alias("pages"), F.any_value("slots").alias("slots"), F.any_value("bands").alias("bands")),
        "contents",
    )
    classes = _near_classes(contents)
    merged = contents.select("host", "shards", "content", shard).join(classes, F.col("content") == F.col("node")).drop("node")

    texts = dealt.mapInArrow(_read(distinct=True), _READ_DDL).select("host", "shard", "shards", F.lit(None).cast("long").alias("content"), F.lit(None).cast("long").alias("root"), "pages")
    told = merged.select("host", "shard", "shards", "content", "root", F.lit(None).cast("binary").alias("pages"))
    in_shards = texts.unionByName(told).withColumn("kind", F.col("pages").isNotNull()).repartition("host", "shard")
    counted = in_shards.sortWithinPartitions("host", "shard", "kind").drop("kind").mapInArrow(_count, _COUNTED_DDL)
    in_buckets = counted.repartition("host", "bucket").sortWithinPartitions("host", "bucket")
    totals = in_buckets.mapInArrow(_add_up, "host string, shard int, grams binary, totals binary")

    fewer = merged.where("content <> root").groupBy("host").agg(F.count("*").alias("fewer"))
    numbers = contents.groupBy("host").agg(F.count("*").alias("contents")).join(fewer, "host", "left")
    salts = F.ceil(F.col("pages") / JUDGED_PAGES).cast("int").alias("salts")
    parts = contents.groupBy("host", shard).agg(F.sum("pages").alias("pages")).select("host", "shard", salts)
    parts = keep(parts.join(numbers, "host").select("host", "shard", "salts", (F.col("contents") - F.coalesce("fewer", F.lit(0))).alias("contents")), "shards")
    every_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    heads = parts.select("host", "shard", every_salt, F.lit(0).alias("kind"), "contents")
    answers = totals.join(F.broadcast(parts.drop("contents")), ["host", "shard"]).select("host", "shard", every_salt, F.lit(1).alias("kind"), "grams", "totals")
    salted = F.broadcast(parts.where("salts > 1").select("host", "shard", "salts"))
    salt = F.expr("cast(pmod(xxhash64(pages), coalesce(salts, 1)) as int)").alias("salt")
    pages = dealt.mapInArrow(_read(distinct=False), _READ_DDL).join(salted, ["host", "shard"], "left").select("host", "shard", salt, F.lit(2).alias("kind"), "pages")
    judged = pages.unionByName(answers, True).unionByName(heads, True).repartition("host", "shard", "salt").sortWithinPartitions("host", "shard", "salt", "kind")
    return judged.mapInArrow(_judge, TEXT_DDL)
