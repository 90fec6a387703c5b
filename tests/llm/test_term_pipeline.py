import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import documents
from pyspark.sql import functions as F

from usemeter.llm import term_pipeline
from usemeter.llm.term_pipeline import contributions, ranked_search, terms_of

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    """All documents against all items, in Python's own integers."""
    split = lambda t: PATTERN.findall((t or "").translate(UPPER))
    counted = [(i, split(t)) for i, t in docs]
    counted = [(i, Counter(t), len(t)) for i, t in counted if t]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, tf, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank + 1, r[3], -r[0]) for rank, r in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark, docs, items):
    d = documents(spark, [(i, t, "en", "a") for i, t in docs], ("id", "term", "block", "item", "head", "bundle", "score"))
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("term", F.lit("x"))


def corpus(seed, n, words):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 60)))) for i in range(n)]
    items = [(i, ", ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 25)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("block_docs, bundle_items, k", [(4096, 256, 10), (7, 4, 10), (64, 1, 3), (50, 256, 1)])
def test_equals_brute_force(spark, block_docs, bundle_items, k):
    docs, items = corpus(1, 600, 300)
    d, i = tables(spark, docs, items)
    assert got(ranked_search(d, i, k=k, block_docs=block_docs, bundle_items=bundle_items)) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \t\n.,-"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha ALPHA"), (6, "é漢 x\x85y ÀÉ"), (5, "gamma " * 50_000 + "alpha"),
        (7, "alpha"), (8, "alpha"), (9, "it's_a-test 0x1F"), (10, "b" * 200_000 + " alpha"), (11, "\U0001f600 smile"),
    ]
    items = [(1, "ALPHA, beta!"), (1, "gamma alpha"), (2, None), (3, ""), (4, "É漢 x\x85y"), (None, "smile \U0001f600 0X1f s a"), (5, "absent"), (6, "b" * 200_000)]
    d, i = tables(spark, docs, items)
    assert got(ranked_search(d, i, block_docs=3, bundle_items=2)) == brute(docs, items)


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "one two three" if i % 2 else "four five six") for i in range(200)] + [(i, "one two three") for i in range(5)]
    items = [(7, "one two"), (8, "six one")]
    d, i = tables(spark, docs, items)
    found = got(ranked_search(d.repartition(7), i, block_docs=16))
    assert found == brute(docs, items) and len(found) == 20


def test_empty_tables_and_common_terms(spark):
    docs, items = [(i, "the same") for i in range(1200)], [(1, "the same")]
    d, i = tables(spark, docs, items)
    assert got(ranked_search(d, i)) == brute(docs, items) == []  # a term of all documents weighs 0
    assert ranked_search(d.limit(0), i).count() == ranked_search(d, i.limit(0)).count() == 0
    assert ranked_search(d.select("doc_id", F.lit("?").alias("text")), i).count() == 0


def test_false_hits_of_the_sketch_end_at_the_join(spark, monkeypatch):
    monkeypatch.setattr(term_pipeline, "SKETCH_BITS", 1 << 15)
    monkeypatch.setattr(term_pipeline, "_sketch", lambda wanted: b"\xff" * (1 << 12))
    docs, items = corpus(2, 100, 200)
    d, i = tables(spark, docs, items)
    assert got(ranked_search(d, i)) == brute(docs, items)


def test_bundles_stay_sparse():
    """What cannot be among the best any more leaves the bundle, and nothing else does."""
    ids, n = list(range(1000)), 1000
    norms = np.full(n, 100, np.int64)
    head = dict(item=None, head=True, ids=ids, places=None, numbers=term_pipeline.planes(norms))
    left = pa.Table.from_pylist([head])
    rare = dict(weight=5000, askers=[dict(item=1, rest=900 * 10**6)], places=term_pipeline.planes(np.arange(0, 20, dtype=np.uint32)), numbers=term_pipeline.planes(np.arange(1, 21)))
    weak = dict(weight=50, askers=[dict(item=1, rest=900 * 10**6)], places=term_pipeline.planes(np.arange(1000, dtype=np.uint32)), numbers=term_pipeline.planes(np.ones(1000, np.int64)))
    _, sums = term_pipeline.visit(left, pa.Table.from_pylist([rare, weak]), 10)
    places, scores = sums[1]
    exact = np.zeros(n, np.int64)
    exact[:20] += contributions(5000, np.arange(1, 21), norms[:20])
    exact += contributions(50, np.ones(n, np.int64), norms)
    tenth = np.sort(exact)[-10]
    assert places.tolist() == np.flatnonzero(exact + 900 * 10**6 >= tenth).tolist() and len(places) < 50
    assert scores.tolist() == exact[places].tolist()


def test_terms():
    assert terms_of("Ab-cD_é Ü\x85 9z\x7f".encode()) == [t.encode() for t in ("ab", "cd", "é Ü\x85", "9z")]
