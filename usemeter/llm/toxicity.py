"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

N-grams are runs of 4, 5 and 6 bytes of the text in lower case (A-Z), hashed to ``1 << BITS`` features; a
document has a feature or not.  From a bounded sample of labelled training rows come the log-count ratio
``r`` of every feature and the ``FEATURES`` features with the highest likelihood ratio (G) against the
label; a logistic regression over ``r * presence`` of these is fitted on the driver.  Scoring is one pass
over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.llm.common import crc32_of_id, keep, narrow, record_batch, releasing, small_batches

GRAMS = (4, 5, 6)
BITS = 20
FEATURES = 4096
#: Labelled rows that the classifier is fitted on at most: those with the least hash of their id.
SAMPLE = 20_000
_RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def gram_features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of ``text`` with a space at either end, some repeated, slice by slice."""
    data = _LOWER[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
    for at in range(0, max(len(data) - GRAMS[0] + 1, 0), _SLICE):
        part = data[at : at + _SLICE + GRAMS[-1] - 1].astype(np.uint64)
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, GRAMS[-1] + 1):
            if len(part) < n:
                break
            gram = (gram[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            if n in GRAMS:
                yield ((gram[:_SLICE] + np.uint64(n)) * _MULTIPLIER) >> np.uint64(64 - BITS)


@dataclass(frozen=True)
class Model:
    """Weights by feature number (0: not looked at) and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.features] = self.weights
        return table

    def scores(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        known = table != 0
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            hits = [f[known[f]] for f in gram_features(text)]
            out[i] = self.bias + (table[np.unique(np.concatenate(hits))].sum(dtype=np.float64) if hits else 0.0)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of a task have each feature."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            grams = list(gram_features(text or ""))
            if grams:
                counts[int(toxic), np.unique(np.concatenate(grams))] += 1
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])], ["feature", "toxic", "other"])


def _has(chosen: np.ndarray):
    """The chosen features that a text has."""

    def has(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                grams = [place[f] for f in gram_features(text or "")]
                found.append(np.unique(np.concatenate([g[g >= 0] for g in grams])) if grams else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], ["toxic", "features"])

    return has


def _logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Regularised logistic regression over ``ratio * presence`` by accelerated gradient steps."""
    n, m = len(rows), len(ratio)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.concatenate(rows) if len(row) else np.zeros(0, np.int64)
    value = ratio[column]
    # Step length from the largest eigenvalue of the Gram matrix, by power iteration.
    v = np.ones(m)
    for _ in range(20):
        v = np.bincount(column, value * np.bincount(row, value * v[column], n)[row], m)
        v /= np.linalg.norm(v) or 1.0
    largest = np.linalg.norm(np.bincount(column, value * np.bincount(row, value * v[column], n)[row], m))
    rate = 1.0 / ((largest + n) / 4 + penalty)
    w, b = np.zeros(m), 0.0
    aw, ab, t = w, b, 1.0
    for _ in range(steps):
        z = ab + np.bincount(row, value * aw[column], n)
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y
        new_w = aw - rate * (np.bincount(column, value * error[row], m) + penalty * aw)
        new_b = ab - rate * error.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        aw, ab = new_w + (before - 1) / t * (new_w - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


def train(rows: DataFrame, penalty: float = 1.0, steps: int = 400) -> Model:
    """The model for ``rows (text, toxic boolean)``, at most ``SAMPLE``; without both classes a constant."""
    counts = rows.groupBy("toxic").count().collect()
    n = {bool(c["toxic"]): c["count"] for c in counts}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    found = rows.mapInArrow(releasing(_presence), "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"))
    p, q = F.col("p"), F.col("q")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (p + q) / float(n1 + n0)
    g = part(p, n1 * share) + part(q, n0 * share) + part(n1 - p, n1 * (1 - share)) + part(n0 - q, n0 * (1 - share))
    best = found.where("p + q >= 3").withColumn("g", F.round(g, 6)).orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    chosen = np.array([r["feature"] for r in best], np.int64)
    ratio = np.array([np.log((r["p"] + 1) / (n1 + 2) / ((r["q"] + 1) / (n0 + 2))) for r in best])
    sample = rows.mapInArrow(releasing(_has(chosen)), "toxic boolean, features binary").collect()
    x = [np.frombuffer(r["features"], "<i4").astype(np.int64) for r in sample]
    order = sorted(range(len(x)), key=lambda i: (sample[i]["toxic"], x[i].tobytes()))  # sums do not follow task order
    weights, bias = _logistic([x[i] for i in order], np.array([float(sample[i]["toxic"]) for i in order]), ratio, penalty, steps)
    return Model(chosen, ratio * weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(text, toxic)`` of at most ``SAMPLE`` labelled rows outside the held-out fold, as a stored table.

    A document labelled twice counts as toxic if any label says so; null labels and ids are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("t")).where("id is not null and t is not null")
    marks = marks.where(crc32_of_id("id") % 3 != 1).groupBy("id").agg((F.max("t") >= 1).alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # no more ids than SAMPLE are broadcast
    rows = narrow(docs, text, key).join(F.broadcast(chosen), "id")
    return keep(rows.select("text", "toxic").repartition(12, F.xxhash64("text")).coalesce(12), "toxicity-sample")  # 12 files, whatever the session deals


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score)`` of every row; the held-out fold is where crc32 of the id modulo 3 is 1.

    Null and empty texts score the bias; a null id is not held out; repeated rows give a row each; empty
    tables give none, or a constant score; other columns are not looked at.  Labels of documents that are not in
    ``docs`` teach nothing.
    """
    model = train(training_rows(docs, labels, text, key))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            yield record_batch(_RESULT, batch.column("id").to_pylist(), model.scores([t or "" for t in batch.column("text").to_pylist()], table))

    scored = narrow(docs, text, key).mapInArrow(releasing(score), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc32_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    model = train(training_rows(docs, labels, text, key))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            scores = model.scores([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], table)
            yield batch.filter(pa.array(scores < threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(releasing(clean), docs.schema)
