"""Exact centroid clustering with Shallot's search.

Vectors are integers, packed into blocks that are written once, in buckets of the block number.  What the search
remembers of a vector (its centroid, the second nearest one, an upper bound of the distance to the first and a
lower bound of that to all others) is a second table in the same buckets, written anew each round: a round joins the
two without moving a vector, and 24 bytes a vector are all that is rewritten.

A vector whose upper bound stays below its lower bound keeps its centroid unseen.  For the others the two remembered
centroids are measured, the scan starts from the closer one and goes through its neighbours by their distance
from it; a neighbour farther than the sum of the distances to the start and to the second-best so far cannot be
one of the two nearest, nor can those behind it, so the ball shrinks with every find.  Bounds are
floating-point numbers rounded to the safe side; what survives them is compared in 64-bit integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.llm.common import discard, keep, partitions, record_batch, scratch

DIMENSIONS = 64
SCALE = 1024
BLOCK = 4096
#: Larger components would not leave 64-bit distances exact.
LIMIT = 1 << 27
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])
_STATE_DDL = "block long, state binary, clusters array<int>, sums binary"
_STATE = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("clusters", pa.list_(pa.int32())), ("sums", pa.binary())])
_FOUND_DDL = "vec_id long, cluster int, distance long"
_FOUND = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
#: first and second centroid, upper bound to the first, lower bound to all others
_KNOWN = np.dtype([("first", "<u4"), ("second", "<u4"), ("upper", "<f8"), ("lower", "<f8")])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``c`` (or of ``c`` itself)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _upper(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * _UP


def _lower(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * _DOWN


class Centres:
    """Centroids with what a round needs of them: neighbours by distance, and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        k = len(now)
        self.at = now
        between = np.stack([squared(now, c) for c in now]) if k else np.zeros((0, 0), np.int64)
        self.order = np.argsort(between, axis=1, kind="stable").astype(np.uint32)
        self.apart = _lower(np.take_along_axis(between, self.order.astype(np.int64), axis=1)) if k else between
        self.moved = _upper(squared(now, before)) if before is not None else np.zeros(k)
        # The farthest move among the other centroids.
        top = np.sort(self.moved)[::-1]
        self.others = np.where(np.arange(k) == (np.argmax(self.moved) if k else 0), top[1] if k > 1 else 0.0, top[0] if k else 0.0)


def search(x: np.ndarray, known: np.ndarray | None, centres: Centres) -> tuple[np.ndarray, int]:
    """What is known of the rows of ``x`` after the centroids have moved, and how many distances were measured.

    ``first`` is each row's nearest centroid, the smallest number among equally near ones.
    """
    c, k = centres.at, len(centres.at)
    if known is None:  # nothing remembered: start from the first two centroids
        known = np.zeros(len(x), _KNOWN)
        known["second"] = min(1, k - 1)
        known["upper"] = np.inf
    known = known.copy()
    known["upper"] = (known["upper"] + centres.moved[known["first"]]) * _UP
    known["lower"] = (known["lower"] - centres.others[known["first"]]) * _DOWN
    if k == 1:
        known["upper"] = _upper(squared(x, c[0]))
        return known, len(x)
    todo = np.flatnonzero(known["upper"] >= known["lower"])
    first, second = known["first"][todo].astype(np.int64), known["second"][todo].astype(np.int64)
    d1, n = squared(x[todo], c[first]), len(todo)
    near = _upper(d1) < known["lower"][todo]  # the bound had only grown loose
    known["upper"][todo[near]] = _upper(d1[near])
    todo, first, second, d1 = todo[~near], first[~near], second[~near], d1[~near]
    d2 = squared(x[todo], c[second])
    n += len(todo)
    swap = (d2 < d1) | ((d2 == d1) & (second < first))
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, other, reach = first.copy(), second.copy(), _upper(d1)
    active = np.arange(len(todo))
    for place in range(k):
        radius = (reach[active] + _upper(d2[active])) * _UP
        active = active[centres.apart[start[active], place] <= radius]
        if not len(active):
            break
        j = centres.order[start[active], place].astype(np.int64)
        fresh = (j != start[active]) & (j != other[active])  # the two remembered ones are measured already
        at, j = active[fresh], j[fresh]
        d = squared(x[todo[at]], c[j])
        n += len(at)
        best = (d < d1[at]) | ((d == d1[at]) & (j < first[at]))
        runner = ~best & (d < d2[at])
        b, r = at[best], at[runner]
        second[b], d2[b] = first[b], d1[b]
        first[b], d1[b] = j[best], d[best]
        second[r], d2[r] = j[runner], d[runner]
    known["first"][todo], known["second"][todo] = first, second
    known["upper"][todo], known["lower"][todo] = _upper(d1), _lower(d2)
    return known, n


def _vectors(df: DataFrame, vector: str, key: str) -> DataFrame:
    """``id, x``: the vectors that take part, as integers."""
    x = F.col("x")
    sound = (F.size("x") == DIMENSIONS) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where(sound)
    large = F.exists(x, lambda v: F.abs(v) >= LIMIT / SCALE)
    whole = F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))
    return rows.select("id", F.when(large, F.raise_error("a component is too large for exact 64-bit distances").cast("array<int>")).otherwise(whole).alias("x"))


def _blocks(vectors: DataFrame, buckets: int) -> DataFrame:
    """The vectors in blocks of what a task reads in a row, stored in buckets of the block number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, ids, rows = TaskContext.get().partitionId() << 32, 0, [], np.zeros((0, DIMENSIONS), np.int32)

        def out(n: int) -> pa.RecordBatch:
            small = not n or np.abs(rows[:n]).max() < 1 << 15
            return record_batch(_BLOCK, [first + number], [ids[:n]], [rows[:n].astype("<i2" if small else "<i4").tobytes()])

        for batch in batches:
            ids += batch.column("id").to_pylist()
            rows = np.concatenate([rows, batch.column("x").flatten().to_numpy().reshape(-1, DIMENSIONS)])
            while len(ids) >= BLOCK:
                yield out(BLOCK)
                number, ids, rows = number + 1, ids[BLOCK:], rows[BLOCK:]
        if ids:
            yield out(len(ids))

    packed = keep(vectors.mapInArrow(pack, "block long, ids array<long>, vectors binary"), "vector-blocks")
    blocks, _ = _bucketed(packed.repartition(buckets, "block"), buckets)
    discard(packed.sparkSession, *packed.inputFiles())
    return blocks


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``df`` stored in buckets of ``block``, so that joins on it move nothing, and its folder."""
    spark, name = df.sparkSession, f"shallot_{uuid.uuid4().hex}"
    path = scratch(spark, "shallot")
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files stay, and ``out`` knows their buckets
    return out, path


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * DIMENSIONS)}").reshape(-1, DIMENSIONS).astype(np.int64)


def _assign(blocks: DataFrame, centres: Centres) -> DataFrame:
    """The state of every block after the search, with each cluster's sums (count first)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, data, state in zip(batch.column("block").to_pylist(), batch.column("ids"), batch.column("vectors"), batch.column("state")):
                x = _unpack(data.as_py(), len(ids.values))
                known, _ = search(x, np.frombuffer(state.as_py(), _KNOWN) if state.is_valid else None, centres)
                order = np.argsort(known["first"], kind="stable")
                clusters, starts = np.unique(known["first"][order], return_index=True)
                counts = np.diff(np.r_[starts, len(x)])
                sums = np.c_[counts, np.add.reduceat(x[order], starts, axis=0)]
                yield record_batch(_STATE, [block], [known.tobytes()], [clusters.tolist()], [sums.astype("<i8").tobytes()])

    return blocks.select("block", "ids", "vectors", "state").mapInArrow(assign, _STATE_DDL)


def _sums(state: DataFrame, k: int) -> np.ndarray:
    """Count and componentwise sums of each of the ``k`` clusters."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for clusters, data in zip(batch.column("clusters").to_pylist(), batch.column("sums")):
                for cluster, row in zip(clusters, np.frombuffer(data.as_py(), "<i8").reshape(len(clusters), -1)):
                    total[cluster] = total[cluster] + row if cluster in total else row
        n = DIMENSIONS + 1
        for cluster, row in total.items():
            yield record_batch(schema, [cluster] * n, range(n), row)

    rows = state.select("clusters", "sums").mapInArrow(spread, "cluster int, place int, value long")
    out = np.zeros((k, DIMENSIONS + 1), np.int64)
    for r in rows.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():  # k * 65 at most
        out[r.cluster, r.place] = r.value
    return out


def _moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters stay."""
    count = sums[:, :1]
    return np.where(count > 0, sums[:, 1:] // np.maximum(count, 1), centroids)


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(F.asc_nulls_last(digest), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, DIMENSIONS)


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors that are null, have not exactly 64 components, or hold a null or non-finite one take no part.  Each
    component x becomes floor(1024 * x).  Centroids start as the ``k`` vectors with the smallest hash (all of them,
    if fewer; ids that are null come last, equal ids in the order of their components).  Each round assigns every
    vector to its nearest centroid, the smaller number among equally near ones, and moves every centroid that has
    vectors to the floor of their mean.  Repeated rows count as often as they come.  No vectors, no rows.  A
    component of 131072 or more, whose distances need not fit 64 bits, stops the job.

    Centroids, their sums and inertias (``k * 65`` numbers) are all that reaches the driver.  Rounds that move nothing
    end the search early: all later ones would give the same.
    """
    spark = df.sparkSession
    vectors = _vectors(df, vector, key)
    centroids = starts(vectors, k, seed)
    buckets, k = partitions(spark), len(centroids)
    blocks = _blocks(vectors, buckets)
    known, folder, before = blocks.withColumn("state", F.lit(None).cast("binary")), None, None
    for _ in range(rounds):
        state, new_folder = _bucketed(_assign(known, Centres(centroids, before)), buckets)
        if folder:
            discard(spark, folder)  # the round before is not read again
        known, folder = blocks.join(state.select("block", "state"), "block"), new_folder
        before, centroids = centroids, _moved(centroids, _sums(state, k))
        if (before == centroids).all():
            break
    return _described(known, Centres(centroids, before))


def _described(known: DataFrame, centres: Centres) -> DataFrame:
    """The vectors of the last assignment with their distances and what their cluster is."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, state in zip(batch.column("ids"), batch.column("vectors"), batch.column("state")):
                x = _unpack(data.as_py(), len(ids.values))
                found, _ = search(x, np.frombuffer(state.as_py(), _KNOWN) if state.is_valid else None, centres)
                yield record_batch(_FOUND, ids.values, found["first"], squared(x, centres.at[found["first"]]))

    rows = keep(known.select("ids", "vectors", "state").mapInArrow(measure, _FOUND_DDL), "shallot-last")
    inertia = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    about = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, at)).encode()).hexdigest())
        for c, at in enumerate(centres.at.tolist())
    ]
    ddl = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    clusters = F.broadcast(rows.sparkSession.createDataFrame(about, ddl))  # a row for each of the k centroids
    return rows.join(clusters, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
