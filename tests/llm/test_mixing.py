import random
from itertools import product

import pytest
from conftest_rows import documents
from pyspark.sql import functions as F

from usemeter.llm import mixing
from usemeter.llm.mixing import min_cost_flow, mix, mix_sources, mixed_documents, water_fill


def test_water_fill():
    assert water_fill([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, 250 / 3, 500 / 3]
    assert water_fill([10, 1000], [3, 1], 1515, 2) == [20.0, 1495.0]
    assert water_fill([0, 5], [3, 1], 7.5, 2) == [0.0, 7.5] and water_fill([], [], 0, 2) == []


def cost(flow, capacities, passes):
    out = 0
    for f, c in zip(flow, capacities):
        left = sum(f)
        for r in range(passes):
            out += r * r * min(left, c)
            left -= min(left, c)
        assert left == 0
    return out


def best(capacities, members, quotas, passes):
    """(words placed, least cost) by trying every whole flow."""
    found = (0, 0)
    options = [[f for f in product(range(c * passes + 1), repeat=len(m)) if sum(f) <= c * passes] for c, m in zip(capacities, members)]
    for flow in product(*options):
        filled = [sum(f[m.index(s)] for f, m in zip(flow, members) if s in m) for s in range(len(quotas))]
        if all(a <= q for a, q in zip(filled, quotas)):
            found = max(found, (sum(filled), -cost(flow, capacities, passes)))
    return found[0], -found[1]


def test_flow_is_largest_and_cheapest():
    rnd = random.Random(3)
    for _ in range(40):
        n = rnd.randint(1, 3)
        members = [sorted(rnd.sample(range(3), rnd.randint(1, 2))) for _ in range(n)]
        capacities, quotas = [rnd.randint(0, 3) for _ in range(n)], [rnd.randint(0, 6) for _ in range(3)]
        flow = min_cost_flow(capacities, members, quotas, 2)
        for s in range(3):
            assert sum(f[m.index(s)] for f, m in zip(flow, members) if s in m) <= quotas[s]
        assert (sum(map(sum, flow)), cost(flow, capacities, 2)) == best(capacities, members, quotas, 2)


def test_sources_come_near_their_targets(spark, words):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), "en", rnd.choice(["a", "b", "ä", None, "a", "a"])) for i in range(400)]
    got = mix_sources(documents(spark, rows)).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    names = ["a", "b", "ä", None]
    sizes = [sum(size[i] for i in size if source[i] == n) for n in names]
    targets = water_fill(sizes, [3, 1, 2, 3], 1.5 * sum(sizes), 2)
    assert len(got) == len(rows)
    for n, total, target in zip(names, sizes, targets):
        mine = [r for r in got if source[r.doc_id] == n]
        assert {(r.source_size, round(r.target, 6)) for r in mine} == {(total, round(target, 6))}
        assert sum(r.taken for r in mine) == round(target)
    assert all(0 <= r.taken <= 2 * r.size and r.size == size[r.doc_id] for r in got)
    again = mix_sources(documents(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b"] if i % 3 == 0 else ["b"] if i % 3 == 1 else [None]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    got = mix(df, F.col("m")).groupBy("pattern").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).collect()
    taken = {tuple(r.pattern): (r.t, r.s) for r in got}
    sizes = [taken[("a", "b")][1], taken[("a", "b")][1] + taken[("b",)][1], taken[(None,)][1]]
    targets = water_fill(sizes, [3, 1, 2], 1.5 * sum(r.s for r in got), 2)
    assert taken[(None,)][0] == round(targets[2])
    assert all(t <= 2 * s for t, s in taken.values())
    # both quotas share the pattern that is in both, and together take as much as they can
    assert taken[("a", "b")][0] + taken[("b",)][0] == min(round(targets[0]) + round(targets[1]), 2 * sizes[1])


def test_odd_rows(odd_docs, odd_rows, no_docs, monkeypatch):
    got = mix_sources(odd_docs).collect()
    assert len(got) == len(odd_rows) and sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=3)
    assert mix_sources(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
    kept = mixed_documents(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} <= {r[0] for r in odd_rows}
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    with pytest.raises(ValueError):
        mix_sources(odd_docs)


def test_what_patterns_give_needs_no_python_workers(spark, odd_docs):
    """The flow goes back to Spark as a table, not as rows that Python workers of their own pickle again."""
    plan = mix_sources(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 0
