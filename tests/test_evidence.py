"""A small hand-written corpus through the gatherer."""

import json

import pytest
from pyspark.sql import functions as F

from usemeter.operators.digest import digest
from usemeter.operators.evidence import call_sites, called_definitions, find, gather
from usemeter.operators.files import definition_names, file_signals


def flow(*providers, **more):
    return json.dumps(dict(components=[dict(provider=p) for p in providers], **more))


CALLING = "const p = load('main.pipe')\n\n  await client.use({p})\nclient.send(1)\nclient.chat(2)\nclient.chat(3)\nclient.chat(4)\nclient.chat(5)\n"

CORPUS = {
    "a/full": [
        ("package.json", '{\n  "dependencies": {"@acme/sdk": "1", "supabase": "2"}\n}\n'),
        ("flows", ""),
        ("flows/main.pipe", flow("webhook", "agent_x", "llm_y", "tool_z", project_id="p1")),
        ("flows/unused.pipe", flow("webhook")),
        ("src/zz.py", "import acme\nx = AcmeClient()\n"),
        ("src/server.ts", CALLING + "// firebase"),
        ("src/index.ts", "// main.pipe is loaded elsewhere"),
        ("README.md", "langchain AcmeClient client.use main.pipe"),
    ],
    "a/first": [
        # two files call it; the hinted one comes first although it is later in the tree
        ("lib/x.py", "client.use('main.pipe')"),
        ("lib/agent.py", "open('EXTRA.MAIN.pipe'); Client.Use(1)"),
        ("main.pipe", "{ not json"),
        ("other.pipe", flow("webhook") + " trailing"),
    ],
    "a/scaffold": [(".claude/rules/acme.md", "x"), ("my-pipelines/readme.md", "y")],
    "a/hosted": [("src/api.js", "fetch(ACME_PIPELINE)\nfetch('/v1/pipelines')")],
    "a/missing": [("requirements.txt", None), ("run.pipe", None), ("src/app.py", None)],
}


def tables(spark, corpus, closed=()):
    repos = [(k, 200, 200, "main", False) for k in corpus] + list(closed)
    tree = [(k, i, p) for k, fs in corpus.items() for i, (p, _) in enumerate(fs)]
    files = [(k, p, t) for k, fs in corpus.items() for p, t in fs if t is not None]
    return (
        spark.createDataFrame(
            repos, "repo_key string, status int, tree_status int, default_branch string, "
                   "tree_truncated boolean"),
        spark.createDataFrame(tree, "repo_key string, tree_ord bigint, path string"),
        spark.createDataFrame(files, "repo_key string, path string, text string"),
    )


@pytest.fixture(scope="module")
def gathered(spark, spec):
    closed = [("b/gone", 404, None, None, None), ("b/half", 200, 409, "main", None)]
    rows = gather(*tables(spark, CORPUS, closed), spec).collect()
    return {r.repo_key: r for r in rows}


def test_full_repo(gathered):
    r = gathered["a/full"]
    assert (r.accessible, r.fetch_incomplete, r.file_count) == (True, False, 8)
    assert r.dependency and not r.scaffold_only
    assert r.other_platforms == ["firebase", "supabase"]
    assert (r.sdk.callsites, r.sdk.file_spread, r.sdk.hosted, r.sdk.engine) == (7, 2, False, False)
    main, unused = r.pipes
    assert main.metrics.asDict() == dict(
        nodes=4, providers=["webhook", "agent_x", "llm_y", "tool_z"], has_agent=True,
        has_llm=True, tool_count=1, project_id="p1")
    assert main.called and not unused.called and unused.call_sites == []
    assert [(s.file, s.line) for s in main.call_sites] == [
        ("src/server.ts", n) for n in (1, 3, 4, 5, 6, 7)]
    assert main.call_sites[1].snippet == "await client.use({p})"


def test_first_file_in_candidate_order_wins_and_names_match_inside_names(gathered):
    r = gathered["a/first"]
    main, other = r.pipes
    assert main.called and main.metrics is None
    assert [(s.file, s.line) for s in main.call_sites] == [("lib/agent.py", 1)]
    assert other.metrics is None and not other.called  # text behind the object


def test_scaffold_and_hosted(gathered):
    assert gathered["a/scaffold"].scaffold_only
    hosted = gathered["a/hosted"].sdk
    assert (hosted.hosted, hosted.engine, hosted.callsites, hosted.file_spread) == (True, True, 0, 0)


def test_missing_texts_count_as_blank(gathered):
    r = gathered["a/missing"]
    assert not r.dependency and r.file_count == 3
    assert [(p.path, p.metrics, p.called) for p in r.pipes] == [("run.pipe", None, False)]


def test_closed_repos(gathered):
    assert gathered["b/gone"].accessible is False
    half = gathered["b/half"]
    assert half.fetch_incomplete and half.note == "tree fetch failed (HTTP 409)"


def test_every_file_counts(spark, spec):
    files = [(f"d{i:02d}.pipe", flow("webhook")) for i in range(14)]
    files += [(f"src/x{i:02d}.py", "client.connect()") for i in range(30)]
    files += [("src/yy.py", "client.use('d00.pipe')"), ("src/agent.py", "client.use('d13.pipe')")]
    files += [(f"m{i}/package.json", "acme" if i == 8 else "-") for i in range(9)]
    r = gather(*tables(spark, {"c/big": files}), spec).first()
    assert [p.path for p in r.pipes] == [f"d{i:02d}.pipe" for i in range(14)]
    assert r.dependency  # said by the ninth manifest
    assert r.sdk.callsites == 32 and [i for i, p in enumerate(r.pipes) if p.called] == [0, 13]


def test_a_repo_of_many_definitions_and_callers(spark, spec):
    n = 1500
    files = [(f"p/d{i:04d}.pipe", flow("agent_x")) for i in range(n)]
    files += [(f"src/s{i:04d}.py", f"client.use('d{i:04d}.pipe')\nclient.use('D{(i + 1) % n:04d}.PIPE')") for i in range(n)]
    found = find(*tables(spark, {"c/huge": files}), spec)
    definitions = called_definitions(found)
    callers = {r.path: r.caller for r in definitions.collect()}
    assert callers == {f"p/d{i:04d}.pipe": f"src/s{0 if i < 2 else i - 1:04d}.py" for i in range(n)}
    assert call_sites(found, definitions).count() == 2 * n


def test_a_long_line_sends_little(spark, spec):
    line = "x" * 2_000_000 + " client.use('main.pipe') " + "y" * 2_000_000
    repos, tree, files = tables(spark, {"c/min": [("main.pipe", flow("webhook")), ("src/min.js", line)]})
    told = file_signals(files, spec, definition_names(tree, spec)).where("path = 'src/min.js'")
    assert told.select(F.length(F.to_json("signals"))).first()[0] < 1000
    assert gather(repos, tree, files, spec).first().pipes[0].called


def test_what_leaves_the_scan_names_something(spark, spec):
    """200 name lengths and 100,000 places of the suffix in one file, few of them names of the repo."""
    names = ["n" * i + ".pipe" for i in range(1, 201)]
    places = " ".join(f"x{i % 50_000}.pipe" for i in range(100_000))
    text = f"client.use(1)\n{places}\n" + "\n".join(f"load z{'n' * i}.pipe" for i in range(1, 201, 7))
    files = [(f"d/{n}", flow("webhook")) for n in names] + [("src/a.py", text)]
    repos, tree, texts = tables(spark, {"c/many": files, "c/other": [("q.pipe", "{}"), ("src/b.py", text)]})
    told = file_signals(texts, spec, definition_names(tree, spec)).where("path like 'src/%'")
    lines = told.select("path", F.explode("signals.call_lines").alias("l")).select("path", "l.line", "l.names").collect()
    assert {r.line for r in lines if r.path == "src/b.py"} == {1}
    by_line = {r.line: r.names for r in lines if r.path == "src/a.py"}
    assert len(by_line.pop(2, [])) < 50  # false hits of the sketch at most
    assert {n: set(v) for n, v in by_line.items()} == {1: set()} | {
        3 + k: {"n" * j + ".pipe" for j in range(1, i + 1)} for k, i in enumerate(range(1, 201, 7))}
    r = {r.repo_key: r for r in gather(repos, tree, texts, spec).collect()}
    assert [len(p.path) - 7 for p in r["c/many"].pipes if p.called] == list(range(1, 198))
    assert not r["c/other"].pipes[0].called


def test_names_that_hold_the_suffix_themselves(spark, spec):
    files = [(n, "{}") for n in ("a.pipe", "a.pipe.pipe", "b.pipe-a.pipe", "c.pipe")]
    files += [("src/x.py", "client.use('q-a.pipe.pipe b.pipe-a.pipe')")]
    r = gather(*tables(spark, {"c/s": files}), spec).first()
    assert {p.path: p.called for p in r.pipes} == {
        "a.pipe": True, "a.pipe.pipe": True, "b.pipe-a.pipe": True, "c.pipe": False}


def test_sites_are_counted_and_the_first_shown(spark, spec):
    text = "\n".join(["open main.pipe"] * 3 + ["client.use(1)"] * 9 + ["load('main.pipe')"])
    r = gather(*tables(spark, {"c/s": [("main.pipe", flow("webhook")), ("src/a.py", text)]}), spec).first()
    assert r.pipes[0].n_sites == 13
    assert [s.line for s in r.pipes[0].call_sites] == [1, 2, 3, 4, 5, 6]


def test_digest(spark, spec):
    rows = {r.repo_key: r for r in digest(*tables(spark, CORPUS), spec).collect()}
    full = rows["a/full"]
    assert full.dependencies == ['package.json: "dependencies": {"@acme/sdk": "1", "supabase": "2"}']
    assert full.pipe_files == ["flows/main.pipe", "flows/unused.pipe"]
    assert full.source_signals == [
        "src/server.ts: client.use(", "src/server.ts: client.chat(",
        "src/zz.py: acmeclient", "src/zz.py: import acme"]
    assert full.other_platforms == ["firebase", "supabase"]
    assert not full.definitions_folder and rows["a/scaffold"].definitions_folder
    assert rows["a/scaffold"].scaffold_only and not rows["a/hosted"].scaffold_only
