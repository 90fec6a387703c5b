"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner products become smallest Euclidean distances: rows are scaled by the largest norm and get one
more component that makes them unit vectors, queries are unit vectors with 0 there.  Each of ``tables``
tables hashes with ``floor((a . x + b) / width)`` for ``hashes`` Gaussian ``a``.  For a query, a perturbed
bucket's chance of holding a neighbour is the product over the hashes of the normal mass that falls into
its cells; ``probes`` buckets a table are visited from the likeliest on.  What they hold is ranked by exact
inner products, tables are merged.  Large buckets are searched in blocks, no bucket is cut short.  Queries that
meet fewer rows than asked for are searched exactly, against all rows in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usemeter.llm.common import keep

BLOCK = 4096
_ENTRY = pa.schema([("table", pa.int32()), ("bucket", pa.int64()), ("query", pa.bool_()), ("id", pa.int64()), ("vector", pa.binary())])
_ENTRY_DDL = "table int, bucket long, query boolean, id long, vector binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Hashing:
    """The tables' functions; ``spread`` is the standard deviation of a neighbour's projection about the query's."""

    tables: int
    hashes: int
    width: float
    probes: int
    spread: float
    seed: int

    def functions(self, dimension: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables, dimension + 1, self.hashes)), rng.uniform(0, self.width, (self.tables, self.hashes))


def default_hashes(rows: int) -> int:
    """One more hash for each tripling of the rows beyond 200,000, so buckets keep about their size."""
    return 4 + max(0, ceil(log(max(rows, 1) / 200_000, 3)))


def default_probes(hashes: int) -> int:
    """Two and a half times the probes for each hash: of three times as many buckets, a somewhat smaller share is visited."""
    return round(64 * 2.5 ** max(0, hashes - 4))


def _bucket(cells: np.ndarray) -> np.ndarray:
    """A number for each row of cells; equal numbers of different cells would only add candidates."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to three digits."""
    return 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))


def probe_order(projections: np.ndarray, spread: float, probes: int) -> np.ndarray:
    """Cells to visit for each query (rows of projections in units of the width), likeliest bucket first.

    The score of a bucket is a sum over hashes, so the best prefixes of every length hold the best buckets.
    """
    base = np.floor(projections)
    steps = np.arange(-2, 3)
    low = (base[:, :, None] + steps - projections[:, :, None]) / spread
    chance = np.log(np.maximum(_normal(low + 1 / spread) - _normal(low), 1e-300))
    score, cells = np.zeros((len(projections), 1)), np.zeros((len(projections), 1, 0))
    for j in range(projections.shape[1]):
        grown = (score[:, :, None] + chance[:, j, None, :]).reshape(len(score), -1)
        best = np.argsort(-grown, axis=1, kind="stable")[:, :probes]
        score = np.take_along_axis(grown, best, 1)
        before = np.take_along_axis(cells, (best // len(steps))[:, :, None], 1)
        cells = np.concatenate([before, (base[:, j, None] + steps[best % len(steps)])[:, :, None]], axis=2)
    return cells.astype(np.int64)


def _entries(hashing: Hashing, dimension: int, norm: float, every: int):
    """Index entries of all rows, and probes of the queries among them."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hashing.functions(dimension)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = np.array(part.column("id").to_pylist(), np.int64)
                vectors = np.array(part.column("vector").to_pylist(), np.float64).reshape(len(ids), dimension)
                packed = np.array([v.tobytes() for v in vectors], object)
                scaled = vectors / norm
                rows = np.c_[scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))]
                asks = ids % every == 0
                asked = np.c_[vectors[asks] / np.linalg.norm(vectors[asks], axis=1, keepdims=True), np.zeros(asks.sum())]
                for t in range(hashing.tables):
                    buckets = _bucket(np.floor((rows @ a[t] + b[t]) / hashing.width))
                    yield _entry_batch(t, buckets, False, ids, packed)
                    if len(asked):
                        probes = _bucket(probe_order((asked @ a[t] + b[t]) / hashing.width, hashing.spread / hashing.width, hashing.probes))
                        n = probes.shape[1]
                        yield _entry_batch(t, probes.reshape(-1), True, np.repeat(ids[asks], n), np.repeat(packed[asks], n))

    return entries


def _entry_batch(table: int, buckets: np.ndarray, query: bool, ids: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, table), pa.int32()), pa.array(buckets), pa.array([query] * n), pa.array(ids), pa.array(packed, pa.binary())], schema=_ENTRY)


def best_of_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` best rows of a block for each query but itself: ``(query, row, score)``, ties to smaller ids.

    Products of all pairs find what may be among the best; these are computed again one by one, so equal vectors
    score equally.
    """
    out = []
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ rows.T
        for q, scores in enumerate(rough, at):
            scores[ids == query_ids[q]] = -np.inf
            if len(scores) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = np.flatnonzero(scores >= edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else np.isfinite(scores))
            else:
                near = np.flatnonzero(np.isfinite(scores))
            exact = (rows[near] * queries[q]).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            out += zip([int(query_ids[q])] * len(order), ids[near][order].tolist(), exact[order].tolist())
    return out


def _rank(k: int):
    def rank(entries: pa.Table) -> pa.Table:
        asks = np.array(entries.column("query").to_pylist(), bool)
        found = []
        if asks.any() and not asks.all():
            ids = np.array(entries.column("id").to_pylist(), np.int64)
            vectors = np.array([np.frombuffer(v, np.float64) for v in entries.column("vector").to_pylist()])
            found = best_of_block(ids[~asks], vectors[~asks], ids[asks], vectors[asks], k)
        return pa.Table.from_arrays([pa.array([f[i] for f in found], kind.type) for i, kind in enumerate(_FOUND)], schema=_FOUND)

    return rank


def _searched(entries: DataFrame, k: int) -> DataFrame:
    """The best rows of each bucket for each query that visits it; a bucket is dealt into blocks of ``BLOCK`` rows.

    A query's visits go to every block of the bucket, in chunks as well, so no group has more than a few
    times ``BLOCK`` entries of either kind.
    """
    sizes = entries.groupBy("table", "bucket").agg(
        F.ceil(F.count_if(~F.col("query")) / F.lit(BLOCK)).cast("int").alias("blocks"), F.ceil(F.count_if("query") / F.lit(BLOCK)).cast("int").alias("chunks")
    )
    sized = entries.join(sizes.where("blocks > 0 and chunks > 0"), ["table", "bucket"])
    here, other = F.col("query"), ~F.col("query")
    own = F.expr("cast(pmod(xxhash64(id), if(query, chunks, blocks)) as int)")
    dealt = sized.withColumn("other", F.explode(F.expr("sequence(0, if(query, blocks, chunks) - 1)"))).withColumn("own", own)
    dealt = dealt.withColumn("block", F.when(here, F.col("other")).otherwise(F.col("own"))).withColumn("chunk", F.when(other, F.col("other")).otherwise(F.col("own")))
    keys = ["table", "bucket", "block", "chunk"]
    found = dealt.select(*keys, "query", "id", "vector").groupBy(*keys).applyInArrow(_rank(k), _FOUND_DDL)
    # Equal rows from several tables share a rank.
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).distinct()


def valid_vectors(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """``(id, vector)`` of what takes part: no nulls, no non-finite components, not zero, the commonest length."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(sound)


def nearest(rows: DataFrame, k: int = 20, every: int = 20, tables: int = 2, hashes: int | None = None, width: float = 1.5, probes: int | None = None, seed: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` the ``k`` largest inner products found.

    Null, zero and unsound vectors and null ids take no part, nor do vectors of another length than the
    commonest.  Of rows with the same id the one with the least vector counts.  Ties go to smaller ids.
    A query without ``k`` other rows gets all there are; an empty table gives none.
    """
    sound = valid_vectors(rows, vector, key)
    lengths = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = rows.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = lengths["n"]
    index = keep(sound.where(F.size("vector") == dimension).groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = index.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    norm = float(np.sqrt(facts["square"])) * (1 + 1e-12)
    hashes = hashes or default_hashes(facts["n"])
    hashing = Hashing(tables, hashes, width, probes or default_probes(hashes), 1.1, seed)
    entries = keep(index.mapInArrow(_entries(hashing, dimension, norm, every), _ENTRY_DDL), "entries")
    found = keep(_searched(entries, k), "found")
    enough = min(k, facts["n"] - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= enough)
    short = index.where(F.col("id") % every == 0).join(full, F.col("id") == F.col("query_id"), "left_anti")
    if enough > 0 and not short.isEmpty():
        packed = _packed(dimension)
        blocks = int(ceil(facts["n"] / BLOCK))
        asked = short.mapInArrow(packed, "id long, vector binary").withColumn("query", F.lit(True)).withColumn("bucket", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
        there = index.mapInArrow(packed, "id long, vector binary").withColumn("query", F.lit(False)).withColumn("bucket", F.expr(f"pmod(xxhash64(id, 7), {blocks})"))
        exact = _searched(asked.unionByName(there).withColumn("table", F.lit(0)), k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")


def _packed(dimension: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, np.float64).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vectors, pa.binary())], ["id", "vector"])

    return pack
