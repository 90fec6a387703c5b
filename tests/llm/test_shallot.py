import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from usemeter.llm import shallot
from usemeter.llm.shallot import Centres, cluster_vectors, search, squared

DDL = "vec_id long, embedding array<double>, label int"


def lloyd(rows, k=8, rounds=10, seed="3"):
    """Every distance of every round, in Python's own integers."""
    kept = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def nearest(x):
        return min((dist(x, y), j) for j, y in enumerate(c))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = [sum(d for _, j, d in found if j == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for i, j, d in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], DDL)
    for name in ("id", "x", "block", "cluster", "state", "n"):
        df = df.withColumn(name, F.lit("x"))
    return df


def clustered(n, centres, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 64))
    return [(i, (c[rng.integers(centres)] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread, k, rounds", [(0.3, 8, 10), (3.0, 8, 10), (0.3, 20, 4), (0.3, 2, 3), (0.3, 1, 2), (0.3, 5, 0)])
def test_equals_every_distance(spark, monkeypatch, spread, k, rounds):
    monkeypatch.setattr(shallot, "BLOCK", 64)
    rows = clustered(400, 12, 5, spread)
    assert got(cluster_vectors(table(spark, rows), k=k, rounds=rounds)) == lloyd(rows, k, rounds)


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 2, 64).astype(float).tolist()) for i in range(150)]
    rows = rows + rows[:60] + [(1000 + i, rows[0][1]) for i in range(50)]
    assert got(cluster_vectors(table(spark, rows))) == lloyd(rows)
    same = [(i, [0.25] * 64) for i in range(30)]  # equal centroids: the smallest number gets all
    assert {r.cluster for r in cluster_vectors(table(spark, same)).collect()} == {0}


def test_unsound_vectors_take_no_part(spark):
    good = clustered(5, 2, 1)
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("-inf")] + [0.0] * 63)]
    zero = [(107, [0.0] * 64), (None, [-0.0004] * 64), (None, [0.5] * 64)]
    assert got(cluster_vectors(table(spark, good + odd + zero))) == lloyd(good + zero)
    few = got(cluster_vectors(table(spark, good[:3])))
    assert few == lloyd(good[:3]) and len({r[1] for r in few}) == 3
    assert cluster_vectors(table(spark, odd)).count() == 0
    assert cluster_vectors(table(spark, good).limit(0)).count() == 0


def test_wide_components(spark):
    rows = [(i, x) for i, x in clustered(40, 3, 9)] + [(50, [131071.0] * 64), (51, [-131071.0] * 64)]
    assert got(cluster_vectors(table(spark, rows), rounds=3)) == lloyd(rows, rounds=3)
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(table(spark, [(1, [131072.0] * 64)])).collect()


def test_bounds_spare_distances():
    rng = np.random.default_rng(7)
    c = rng.integers(-2000, 2000, (60, 64))
    x = c[rng.integers(60, size=3000)] + rng.integers(-300, 300, (3000, 64))
    centres, before, known, measured = rng.permutation(x)[:60].astype(np.int64), None, None, []
    for _ in range(8):
        known, n = search(x, known, Centres(centres, before))
        measured.append(n)
        d = np.stack([squared(x, y) for y in centres], axis=1)
        assert (known["first"] == d.argmin(axis=1)).all()
        low = np.sort(d, axis=1)
        assert (known["upper"] ** 2 >= low[:, 0]).all() and (known["lower"] ** 2 <= low[:, 1]).all()
        before, sums = centres, np.zeros((60, 65), np.int64)
        np.add.at(sums, known["first"], np.c_[np.ones(3000, np.int64), x])
        centres = shallot._moved(centres, sums)
    assert measured[0] < 3000 * 60 and sum(measured[1:]) < 0.15 * 7 * 3000 * 60


def test_rounds_move_no_vectors(spark):
    """The join of vectors and state stands on buckets: no exchange below it."""
    blocks, _ = shallot._bucketed(spark.range(50).selectExpr("id AS block", "binary('x') AS vectors"), 4)
    state, _ = shallot._bucketed(spark.range(50).selectExpr("id AS block", "binary('y') AS state"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks.join(state, "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
