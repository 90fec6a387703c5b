import random
import zlib

import numpy as np
from conftest_rows import documents

from usemeter.llm.toxicity import BITS, drop_toxic, gram_features, toxicity_scores, train

RUDE = ["idiotic", "vejuté", "schurkig"]


def corpus(words, n=1500):
    rnd = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 80))]
        for _ in range(rnd.randint(1, 3) if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(RUDE))
        rows.append((i, " ".join(text), "en", "a"))
        if i % 2 == 0:
            marks.append((i, 1, int(toxic)))
    return rows, marks


def test_held_out_accuracy(spark, words):
    rows, marks = corpus(words)
    docs = documents(spark, rows)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    unseen = [(r.score >= 0.7, i % 6 == 0) for i, r in got.items() if r.held_out or i % 2]
    assert np.mean([a == b for a, b in unseen]) > 0.99
    again = {r.doc_id: r.score for r in toxicity_scores(docs.repartition(7), labels.repartition(3)).collect()}
    assert max(abs(again[i] - r.score) for i, r in got.items()) < 1e-9
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.7}


def test_held_out_labels_teach_nothing(spark, words):
    rows, marks = corpus(words, 600)
    docs = documents(spark, rows)
    wrong = [(i, q, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, q, t in marks]
    ddl = "doc_id long, quality int, toxic int"
    a = {r.doc_id: r.score for r in toxicity_scores(docs, spark.createDataFrame(marks, ddl)).collect()}
    b = {r.doc_id: r.score for r in toxicity_scores(docs, spark.createDataFrame(wrong, ddl)).collect()}
    assert a == b


def test_odd_rows(spark, odd_docs, odd_rows, no_docs, words):
    rows, marks = corpus(words, 300)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity_scores(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity_scores(no_docs, labels).count() == 0
    assert toxicity_scores(odd_docs, labels.limit(0)).count() == len(odd_rows)
    assert drop_toxic(odd_docs, labels).columns == odd_docs.columns


def test_grams_of_slices_are_those_of_the_whole(monkeypatch):
    from usemeter.llm import toxicity

    text = "Some TEXT with é and more words"
    whole = sorted(x for f in gram_features(text) for x in f.tolist())
    monkeypatch.setattr(toxicity, "_SLICE", 7)
    assert sorted(x for f in toxicity.gram_features(text) for x in f.tolist()) == whole
    assert max(whole) < 1 << BITS and whole == sorted(x for f in gram_features(text.replace("TEXT", "text")) for x in f.tolist())


def test_one_class_gives_a_constant(spark):
    model = train(spark.createDataFrame([("a", True), ("b", True)], "text string, toxic boolean"))
    assert model.bias > 0 and len(model.features) == 0
