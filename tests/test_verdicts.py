"""Captured-evidence cases: the documented ones and the borders between tags."""

import json

import pytest

from usemeter.operators.reports import case_tally, expected_diff
from usemeter.operators.verdicts import evaluate
from usemeter.sources.snapshots import read_cases


def definition(nodes, called, agent=True, llm=True, tools=1, path="flow.pipe", metrics=True):
    m = dict(nodes=nodes, providers=[], has_agent=agent, has_llm=llm, tool_count=tools,
             project_id="")
    sites = [dict(file="src/a.ts", line=3, snippet="client.use()")] if called else []
    return dict(path=path, metrics=m if metrics else None, called=called, call_sites=sites)


def evidence(dep=False, scaffold=False, platforms=(), sdk=(0, 0, False, False), pipes=(), **more):
    keys = ("callsites", "file_spread", "hosted", "engine")
    return dict(accessible=True, dependency=dep, scaffold_only=scaffold,
                other_platforms=list(platforms), sdk=dict(zip(keys, sdk)), pipes=list(pipes), **more)


CASES = {
    # the six documented cases, with invented names
    "builder": (evidence(True, platforms=["butterbase"], sdk=(8, 2, True, False),
                         pipes=[definition(7, True)]), ("Significant", "Yes", 7.0)),
    "beside another runtime": (evidence(True, platforms=["langchain"], sdk=(4, 2, False, False),
                                        pipes=[definition(6, True)]), ("Significant", "Partial", 6.0)),
    "hosted only": (evidence(True, sdk=(4, 2, True, False)), ("Moderate", "Yes", 3.0)),
    "for show": (evidence(True, pipes=[definition(6, False)]), ("None", "No", 0.0)),
    "dead code, hosted": (evidence(platforms=["butterbase"], sdk=(1, 1, True, False),
                                   pipes=[definition(0, False, False, False, 0)]), ("None", "No", 0.0)),
    "scaffold only": (evidence(scaffold=True), ("Less", "No", 0.0)),
    # borders
    "score 1": (evidence(True), ("Less", "No", 1.0)),
    "score 0.5": (evidence(sdk=(3, 1, False, False)), ("None", "No", 0.5)),
    "score 2": (evidence(True, sdk=(0, 0, True, False)), ("Moderate", "Yes", 2.0)),
    "score 1.5 couples": (evidence(sdk=(3, 0, True, False)), ("Less", "No", 1.5)),
    "score 4, no backbone": (evidence(pipes=[definition(3, True, False, False, 0, f"{i}.pipe")
                                             for i in range(2)]), ("Moderate", "No", 4.0)),
    "score 4": (evidence(pipes=[definition(4, True, True, False, 1)]), ("Significant", "Yes", 4.0)),
    "scaffold, hosted, high": (evidence(True, True, sdk=(9, 9, True, True)), ("Less", "No", 3.0)),
    "scaffold, called": (evidence(False, True, pipes=[definition(3, True, True, True, 0)]),
                         ("Moderate", "Yes", 3.5)),
    "unparseable but called": (evidence(pipes=[definition(0, True, metrics=False)]),
                               ("Moderate", "No", 2.0)),
    "8 nodes": (evidence(pipes=[definition(8, True, False, False, 0)]), ("Moderate", "No", 2.5)),
    "9 nodes": (evidence(pipes=[definition(9, True, False, False, 0)]), ("Moderate", "No", 3.0)),
    "spread 2, calls 2": (evidence(True, sdk=(2, 2, False, False)), ("Less", "No", 1.5)),
    "engine gives no points": (evidence(True, sdk=(3, 2, False, True)), ("Moderate", "Yes", 2.0)),
    "overclaim": (evidence(True, sdk=(9, 9, True, False), overclaim=True), ("None", "No", 3.0)),
    "penalty outweighs": (evidence(pipes=[definition(3, True, False, False, 0, "a.pipe")]
                                   + [definition(3, False, path=f"{i}.pipe") for i in range(3)]),
                          ("None", "No", 0.0)),
}


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    for i, (name, (ev, exp)) in enumerate(CASES.items()):
        expect = dict(zip(("tag", "backbone", "score"), exp))
        body = dict(name=name, evidence=ev, expect=expect)
        (root / f"{i:02d}.json").write_text(json.dumps(body, indent=1), encoding="utf-8")
    (root / "99.json").write_text(json.dumps(dict(
        name="closed", evidence=dict(accessible=False, status=404),
        expect=dict(tag="None", backbone="No"))), encoding="utf-8")
    return read_cases(spark, str(root))


def test_all_cases(spark, spec, cases):
    verdicts = evaluate(cases, spec)
    wanted = cases.select("name", "expect.*")
    diff = expected_diff(verdicts, wanted, "name", ("tag", "backbone", "score"))
    assert diff.collect() == []
    tally = case_tally(cases, diff, "name").first()
    assert (tally.passed, tally.failed) == (len(CASES) + 1, 0)


def test_a_wrong_expectation_is_reported(spark, spec, cases):
    from pyspark.sql import functions as F

    wanted = cases.select("name", "expect.*").withColumn(
        "tag", F.when(F.col("name") == "score 1", "Moderate").otherwise(F.col("tag"))
    )
    diff = expected_diff(evaluate(cases, spec), wanted, "name", ("tag", "backbone", "score"))
    assert [tuple(r) for r in diff.collect()] == [("score 1", "tag", "Moderate", "Less")]
    assert case_tally(cases, diff, "name").first().failed == 1


def test_breakdown_order_and_texts(spark, spec, cases):
    row = evaluate(cases, spec).where("name = 'builder'").first()
    assert [(b.signal, b.points) for b in row.breakdown] == [
        ("dependency in manifest", 1.0),
        ("pipeline called: flow.pipe", 2.0),
        ("agent node in flow.pipe", 1.0),
        ("complexity mid (7 nodes)", 0.5),
        ("tool/llm node in flow.pipe", 0.5),
        ("hosted-pipeline usage", 1.0),
        ("SDK call-sites (8)", 0.5),
        ("SDK spread (2 files)", 0.5),
    ]
    assert (row.pipelines_called, row.pipelines_total) == (1, 1)


def test_evaluation_needs_no_shuffle(spark, spec, cases):
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(evaluate(cases, spec)) == shuffles(cases)
