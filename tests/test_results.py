"""Submissions to results: routes, prose, duplicates, sheet, sinks."""

import json

import pytest
from pyspark.sql import functions as F
from test_evidence import CALLING, flow, tables

from usemeter.functions import present
from usemeter.operators import reports
from usemeter.operators.duplicates import duplicate_members, duplicate_notes, mark_duplicates
from usemeter.operators.replies import first_prose
from usemeter.operators.results import failed_rows, public_rows, sheet_rows, with_default_project
from usemeter.plans import verification
from usemeter.plans.verification import verify
from usemeter.sources import sinks
from usemeter.sources.sheets import load_submissions
from usemeter.sources.snapshots import Snapshot, read_snapshot

CORPUS = {
    "own/good": [("package.json", "@acme/sdk"), ("main.pipe", flow("agent_a", "llm_b")),
                 ("src/server.ts", CALLING)],
    "own/plain": [("README.md", "nothing")],
}
CLOSED = [("own/gone", 404, None, None, None), ("own/half", 200, 500, "main", None),
          ("own/never", None, None, None, None)]
LINKS = ["https://github.com/Own/Good.git", "github.com/own/good/tree/main", "n/a", "github.com/solo",
         "https://github.com/own/gone", "https://github.com/own/half", "https://github.com/own/never",
         "https://github.com/own/unknown", "https://github.com/own/plain"]


@pytest.fixture(scope="module")
def submissions(spark):
    rows = [(i, f"P{i}", "Ann, Bob" if i % 2 else "", "a@b.example", link, "fine", "", None)
            for i, link in enumerate(LINKS)]
    return spark.createDataFrame(
        rows, "ord bigint, project string, names string, emails string, github string, "
              "feedback string, demo string, deployed string")


@pytest.fixture(scope="module")
def replies(spark):
    prose = json.dumps(dict(description="d", acme_usage="u", justification="j"))
    return spark.createDataFrame(
        [(0, 1, "no object"), (0, 2, f"well {prose} {{x}}"), (0, 3, '{"description": "late"}'),
         (8, 4, prose)], "ord bigint, attempt int, reply string")


@pytest.fixture(scope="module")
def results(spark, spec, submissions, replies, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("snapshot"))
    for name, df in zip(("repos", "repo_tree", "repo_files"), tables(spark, CORPUS, CLOSED)):
        df.write.parquet(f"{root}/{name}")
    return verify(submissions, read_snapshot(spark, root), replies, spec).cache()


@pytest.fixture(scope="module")
def by_ord(results):
    return {r.ord: r for r in results.collect()}


def test_routes(by_ord):
    assert {o: (r.route, r.repo_accessible) for o, r in by_ord.items()} == {
        0: ("evaluate", True), 1: ("evaluate", True), 2: ("no_repo", False),
        3: ("unparseable", False), 4: ("inaccessible", False), 5: ("incomplete", None),
        6: ("inaccessible", False), 7: ("inaccessible", False), 8: ("evaluate", True)}


def test_texts_of_rows_not_evaluated(by_ord):
    assert by_ord[2].notes == "No GitHub repo provided — flag for correction; scored as ZERO"
    assert by_ord[3].notes.startswith("INACCESSIBLE (HTTP ?)")
    assert by_ord[4].notes.startswith("INACCESSIBLE (HTTP 404)")
    assert by_ord[6].notes.startswith("INACCESSIBLE (HTTP None)")
    assert by_ord[5].notes == (
        "Evidence fetch incomplete (tree fetch failed (HTTP 500)) — resubmit this row")
    assert "Acme usage cannot be verified" in by_ord[4].justification
    for o in (2, 3, 4, 5, 6, 7):
        r = by_ord[o]
        assert (r.tag, r.backbone, r.score, r.pipelines, r.evidence) == ("None", "No", 0.0, [], [])
        assert not r.explain_failed


def test_verdict_and_prose(by_ord):
    r = by_ord[0]
    assert (r.tag, r.backbone, r.score) == ("Significant", "Yes", 5.0)
    assert (r.description, r.usage, r.justification, r.explain_failed) == ("d", "u", "j", False)
    note = "Deterministic score 5.0 -> Significant / backbone Yes; 1/1 pipeline(s) called."
    assert r.notes == note + "; duplicate repo (2 rows share own/good)"
    # no reply: the verdict stands
    assert by_ord[1].explain_failed and by_ord[1].justification.startswith(note + " (Plain-English")
    assert by_ord[1].notes == (
        note + " [explanation pending — cloud classifier unreachable]; duplicate repo (2 rows share own/good)")
    assert not by_ord[8].explain_failed  # a fourth attempt counts too
    assert by_ord[0].evidence == [
        "main.pipe — 2 nodes (low), agent — CALLED @ src/server.ts:1; src/server.ts:3; src/server.ts:4",
        "SDK: 6 call-site(s) across 1 file(s)"]


def test_sheet_and_public_rows(spec, results):
    sheet = {r.ord: r for r in sheet_rows(results, spec).collect()}
    assert sheet[0].team_details == "a@b.example" and sheet[1].team_details == "Ann, Bob / a@b.example"
    assert sheet[0].called_total == "1 / 1" and sheet[2].called_total == "0 / 0"
    assert sheet[0].evidence.count("\n") == 1 and sheet[0].deployed == ""
    public = {r.ord: r for r in public_rows(results, spec).collect()}
    assert public[0].acme_usage == "u"
    assert public[0].layers == dict(ingest="none", retrieval="none", orchestration="acme",
                                    reasoning="acme", output="none")


def test_layer_map_takes_valid_given_values(spark, spec):
    df = spark.createDataFrame([("partial", {"ingest": " Other ", "reasoning": "bad"})],
                               "b string, g map<string,string>")
    assert df.select(present.layer_map(F.col("b"), spec, F.col("g")).alias("l")).first().l == dict(
        ingest="other", retrieval="none", orchestration="acme", reasoning="other", output="none")


def test_counts_and_failed(results):
    grouped = reports.with_review_group(results)
    counts = {(r.facet, r.value): r.n
              for r in reports.verdict_counts(grouped, "tag", "review_group").collect()}
    assert counts == {("tag", "Significant"): 2, ("tag", "None"): 7, ("review_group", "Yes"): 2,
                      ("review_group", "No"): 1, ("review_group", "review"): 6}
    assert failed_rows(results).count() == 6


def test_timing_leaves_out_zero(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "seconds double")
    assert tuple(reports.timing(df).first()) == (3.0, 4.0, 2)


def test_sinks_round_trip(spark, spec, results, tmp_path):
    sinks.write_needs_review(results, str(tmp_path / "review"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "review").glob("part-*.csv")))
    assert text.startswith("﻿Project title,Team Members Names".encode())
    again = load_submissions(spark, str(tmp_path / "review"), spec, columns=8)
    assert {r.github for r in again.collect()} == set(LINKS[2:8])
    sinks.write_ndjson(results, str(tmp_path / "lines"), spec)
    lines = [json.loads(x) for p in sorted((tmp_path / "lines").glob("part-*"))
             for x in p.read_text(encoding="utf-8").splitlines()]
    lines.sort(key=lambda x: x["project"])
    assert [x["project"] for x in lines] == [f"P{i}" for i in range(9)]
    assert len(lines[0]) == 24 and lines[5]["repo_accessible"] is None
    sinks.write_sheet(results, str(tmp_path / "sheet"), spec, form="csv")
    head = next(iter(sorted((tmp_path / "sheet").glob("part-*.csv")))).read_text().splitlines()[0]
    assert head.startswith("Project Name,Team Details (Names / Emails)")
    sinks.write_sheet(results, str(tmp_path / "parquet"), spec)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 9


def test_packed_lines_hold_the_same_in_less(spark, spec, results, tmp_path):
    many = results.withColumn("seconds", F.explode(F.expr("transform(sequence(1, 200), x -> double(x))"))).coalesce(1)
    size = {}
    for form in ("none", "gzip"):
        sinks.write_ndjson(many, str(tmp_path / form), spec, compression=form)
        size[form] = sum(p.stat().st_size for p in (tmp_path / form).glob("part-*"))
    lines = [sorted(r.value for r in spark.read.text(str(tmp_path / f)).collect()) for f in size]
    assert lines[0] == lines[1] and len(lines[0]) == 9 * 200
    assert size["gzip"] < size["none"] / 10


def test_default_project(spark, spec):
    df = spark.createDataFrame([(" ", "github.com/o/Rep.git"), ("", "n/a"), ("x", "github.com/o/r")],
                               "project string, github string")
    assert [r.project for r in with_default_project(df, spec).collect()] == ["Rep", "", "x"]


# --- duplicates --------------------------------------------------------------------------


def test_duplicates_of_any_size_have_one_form(spark, spec):
    rows = [(i, f"n{i % 5}", "https://github.com/hot/one" if i % 3 == 0 else
             f"https://github.com/o/r{i // 4}" if i % 3 == 1 else "none") for i in range(600)]
    df = spark.createDataFrame(rows, "ord bigint, project string, github string")
    groups = {}
    for o, _, url in rows:
        if "github.com" in url:
            groups.setdefault(url.removeprefix("https://github.com/"), []).append(o)
    want = {o: (len(g), f"duplicate repo ({len(g)} rows share {k})") for k, g in groups.items() if len(g) > 1 for o in g}
    assert {r.ord: (r.n, r.note) for r in duplicate_notes(df, spec).collect()} == want
    assert duplicate_members(df, spec).where("repo_key = 'hot/one'").count() == 200


def test_notes_join_the_rows_own(spark, spec):
    rows = [(1, "a", "github.com/o/r", ""), (2, "a", "github.com/O/R.git", "seen")]
    df = spark.createDataFrame(rows, "ord bigint, project string, github string, notes string")
    notes = {r.ord: r.notes for r in mark_duplicates(df, spec).collect()}
    assert notes == {1: "duplicate repo (2 rows share o/r)", 2: "seen; duplicate repo (2 rows share o/r)"}


def test_drift(spark):
    a = spark.createDataFrame([(1, "Less"), (2, "None")], "k int, tag string")
    b = spark.createDataFrame([(1, "Less"), (2, "Less")], "k int, tag string")
    assert [tuple(r) for r in reports.drift(a, b, "k").collect()] == [(2, "None", "Less")]


def test_only_submitted_repos_are_evaluated(spark, spec, submissions):
    corpus = {**CORPUS, "own/other": [("src/server.ts", CALLING)]}
    snapshot = Snapshot(*tables(spark, corpus, CLOSED))
    few = verification.submitted_only(snapshot, submissions, spec)
    named = {"own/good", "own/plain", "own/gone", "own/half", "own/never"}
    assert {r.repo_key for r in few.repos.collect()} == named
    assert {r.repo_key for r in verification.repo_outcomes(few, spec).collect()} == named
