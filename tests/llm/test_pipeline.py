import hashlib
import os
from collections import Counter

import numpy as np
import pytest
import test_line_chunks
import test_ngram_join
from compare import connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from usemeter.llm.bpe import vocabulary_path
from usemeter.llm.mixing import water_fill
from usemeter.llm.queries import ORACLE, QUERIES, VOCABULARY
from usemeter.llm.toxicity import toxicity_scores

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_stages_hand_on_documents(spark):
    docs = first = corpus_pipeline.table(spark, SF_DIR, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF_DIR), "test-stage")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert counts[0] < first.count() and counts[1] == counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_equal_brute_force(spark):
    """Each stage's rows from its input by plain Python: chunk texts, all pairs, quotas, the library."""
    stage = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    clean = corpus_pipeline.keep(stage["toxicity"](spark, docs, SF_DIR), "clean")
    labels = corpus_pipeline.table(spark, SF_DIR, "labels")
    scores = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, x in scores.items() if x < 0.7}

    lines = corpus_pipeline.keep(stage["line dedup"](spark, clean, SF_DIR), "lines")
    want = test_line_chunks.brute([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == want

    unique = corpus_pipeline.keep(stage["n-gram Jaccard join"](spark, lines, SF_DIR), "unique")
    groups = test_ngram_join.brute([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in unique.collect()} == {i for i, _, least in groups if i == least}

    mixed = corpus_pipeline.keep(stage["source mixing"](spark, unique, SF_DIR), "mixed")
    size, source = {}, {}
    for r in unique.collect():
        size[r.doc_id], source[r.doc_id] = len((r.text or "").encode().split()), r.source
    names = sorted(set(source.values()))
    sizes = [sum(size[i] for i in size if source[i] == n) for n in names]
    targets = water_fill(sizes, [[3.0, 1.0, 2.0][i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    times = Counter(r.doc_id for r in mixed.collect())
    for name, target in zip(names, targets):
        own = [i for i in size if source[i] == name]
        assert abs(sum(times[i] * size[i] for i in own) - target) <= 0.5 * max(size[i] for i in own) + 1
    assert max(times.values()) <= 2 and not any(times[i] for i in size if not size[i])

    encoder = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    for r in stage["BPE encoding and decoding"](spark, unique, SF_DIR).join(unique.select("doc_id", "text"), "doc_id").collect():
        ids = encoder.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_answer_for_every_row(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    table = {
        "op2_html_extraction": "pages", "op7_nearest_neighbours": "embeddings", "op11_centroid_clustering": "embeddings",
        "op12_ranked_search": "benchmark", "op13_warc_archive": "pages",
    }.get(name, "documents")
    n = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    rows = {"op7_nearest_neighbours": 20 * len(range(0, n, 20)), "op12_ranked_search": 10 * n}.get(name, n)
    assert got.count() == rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    from compare import compare

    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR) is None
