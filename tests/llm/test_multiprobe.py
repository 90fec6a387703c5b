import numpy as np
import pytest
from pyspark.sql import functions as F

from usemeter.llm.multiprobe import _bucket, best_of_block, default_hashes, default_probes, nearest, probe_order
from usemeter.llm import multiprobe

DDL = "vec_id long, embedding array<float>, label int"


def exact(ids, x, q, k):
    s = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("unit, hashes", [(True, None), (False, None), (True, 6)])
def test_recall(spark, unit, hashes):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x *= rng.uniform(0.5, 2, (3000, 1)) if not unit else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], DDL)
    got = found(nearest(df, hashes=hashes).collect())
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        want = exact(np.arange(3000), x, q, 20)
        assert len(got[q]) == 20
        assert all(abs(s - float((x[i] * x[q]).sum())) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda f: (-f[1], f[0])) and q not in [i for i, _ in got[q]]
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
    assert hits >= 0.9 * 20 * 150


def test_parameters_follow_the_number_of_rows():
    assert [default_hashes(n) for n in (0, 500, 200_000, 200_001, 600_001, 10**10)] == [4, 4, 4, 5, 6, 14]
    assert [default_probes(h) for h in (2, 4, 5, 6)] == [64, 64, 160, 400]


def test_few_rows_and_ties_are_exact(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "BLOCK", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 8))
    x[5:25] = x[5]  # ties go to smaller ids
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = found(nearest(df, k=20, every=5, hashes=6, probes=3).collect())
    for q in range(0, 30, 5):
        want = exact(np.arange(30), x, q, 20)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
    few = found(nearest(df.where("vec_id < 4"), k=20, every=2).collect())
    assert {q: len(v) for q, v in few.items()} == {0: 3, 2: 3}


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0),
            (6, [None, 1.0], 0), (None, [1.0, 1.0], 0), (20, [1.0, 2.0, 3.0], 0), (7, [0.5, 0.5], 0), (7, [0.5, 0.5], 0), (8, [], 0)]
    df = spark.createDataFrame(rows, DDL).withColumn("id", F.lit(1)).withColumn("vector", F.lit("x")).withColumn("rank", F.lit(0))
    assert found(nearest(df).collect()) == {0: [(1, 0.5), (7, 0.5)]}
    assert nearest(df.where("vec_id is null")).count() == 0 and nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id = 0")).count() == 0


def test_probes_come_in_order_of_their_chance():
    projections = np.array([[0.9, 3.5, -1.2]])
    cells = probe_order(projections, 0.5, 125)[0]
    assert cells[0].tolist() in ([0, 3, -2], [1, 3, -2]) and len({tuple(c) for c in cells.tolist()}) == 125
    distance = [(np.abs(c + 0.5 - projections[0])).sum() for c in cells]
    assert np.mean(distance[:10]) < np.mean(distance[-50:])
    assert len(set(_bucket(cells).tolist())) == 125


def test_block_leaves_out_the_query_itself():
    x = np.eye(3)
    assert best_of_block(np.array([1, 2, 3]), x, np.array([2]), x[1:2], 5) == [(2, 1, 0.0), (2, 3, 0.0)]
