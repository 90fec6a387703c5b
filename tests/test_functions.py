"""Scalar functions against plain Python on the same inputs."""

import contextlib
import json
from itertools import accumulate

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usemeter.functions.definitions import parse_definition
from usemeter.functions.repo import first_link, repo_key, repo_missing, repo_name, repo_owner
from usemeter.functions.replies import last_object, simple_object, verdict_object
from usemeter.functions.text import first_line, header_key, lines, name_key, strip


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.withColumn("out", fn(F.col("v"))).orderBy("i").collect()]


TEXTS = ["", " ", "\n", "a", "a\n", "a\n\n", "\r\na\rb\x0bc\x0c\x1cd\x1e\x85e f ",
         "\xa0 A  b　C\t", "x" * 300, "é\nÈ", "\x1fq\x1f"]


def test_text_helpers(spark):
    assert apply(spark, TEXTS, lines) == [t.splitlines() for t in TEXTS]
    assert apply(spark, TEXTS, strip) == [t.strip() for t in TEXTS]
    assert apply(spark, TEXTS, name_key) == [
        " ".join(t.lower().split()) for t in TEXTS]
    assert apply(spark, [None, "Git-Hub Repo (ALL)", "É1"], header_key) == ["", "githubrepoall", "1"]
    assert apply(spark, ["a", " t \n more", "\nx"], first_line) == ["a", "t", ""]


LINKS = {
    "https://github.com/Own/Repo.git": ("own/repo", "Own", "Repo"),
    "git@github.com:Own/Repo": ("own/repo", "Own", "Repo"),
    "see GitHub.com/Own/Repo/tree/main?x#y": ("own/repo", "Own", "Repo"),
    "github.com//Own/Re.po?tab=1": ("own/re.po", "Own", "Re.po"),
    "https://github.com/Own": ("https://github.com/own", "", ""),
    " N/A ": ("n/a", "", ""),
}


def test_repo_parts(spark, spec):
    urls = list(LINKS)
    assert apply(spark, urls, lambda c: repo_key(c, spec)) == [v[0] for v in LINKS.values()]
    assert apply(spark, urls, lambda c: repo_owner(c, spec)) == [v[1] for v in LINKS.values()]
    assert apply(spark, urls, lambda c: repo_name(c, spec)) == [v[2] for v in LINKS.values()]
    assert apply(spark, [*urls, None], lambda c: repo_missing(c, spec)) == [False] * 5 + [True] * 2


def test_first_link(spark, spec):
    cells = ["Demo: https://a.example/x).", "www.b.example, more", "GitHub.com/o/r;", "none", None,
             "HTTP://c.example"]
    assert apply(spark, cells, lambda c: first_link(c, spec)) == [
        "https://a.example/x", "https://www.b.example", "https://GitHub.com/o/r", None, None,
        "HTTP://c.example"]


@pytest.mark.parametrize("text, nodes", [
    ('{"components": [{"provider": "agent_a"}, {}], "project_id": null}', 2),
    ('{"components": null}', 0), ("{}", 0), (' {"a": 1}\n', 0),
    ("", None), ("[]", None), ("{", None), ('{"a": 1} x', None), ('{"a": 1} {"b": 2}', None),
    ('{"a": 1}, {"b": 2}', None), ('{"a": 1}} x}', None), ('{"a": 1}] x', None),
    ("{'a': 1}", None), ('{"components": [1]}', None),
])
def test_definition_texts(spark, text, nodes):
    got = apply(spark, [text], parse_definition)[0]
    assert (got.nodes if got else None) == nodes


def expected_last(text, wanted):
    """From the running depth (never below zero): objects open at depth 0 and close at depth 1."""
    change = {"{": 1, "}": -1}
    depth = list(accumulate(text, lambda d, c: max(0, d + change.get(c, 0)), initial=0))
    opens = [i for i, c in enumerate(text) if c == "{" and depth[i] == 0]
    closes = [i for i, c in enumerate(text) if c == "}" and depth[i] == 1]
    usable = []
    for first, last in zip(opens, closes):
        body = text[first:last + 1]
        with contextlib.suppress(ValueError):
            usable += [body] if set(json.loads(body)) & set(wanted) else []
    return usable[-1] if usable else None


piece = st.sampled_from(["{", "}", '{"usage": 1}', '{"x": {"usage": 2}}', "text ", '"', "\n",
                         '{"description": "}"}', '{"description": "a", "b": [1, 2]}', "é"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(piece, max_size=8).map("".join), min_size=60, max_size=60))
def test_last_object_equals_a_plain_scan(spark, texts):
    wanted = ("description", "usage")
    assert apply(spark, texts, lambda c: last_object(c, wanted)) == [
        expected_last(t, wanted) for t in texts]


def test_simple_object(spark):
    replies = ['x ```json\n{"a": 1}\n``` {"b": 2}', 'x {"a": {"b": 1}} y', "none", "", "{a}",
               '{"a": 1} and {"b": 2}']
    assert apply(spark, replies, simple_object) == [
        '{"a": 1}', '{"a": {"b": 1}}', None, None, None, None]


def test_verdict_object(spark):
    replies = ['{"tag": "Less"} {"tag": "None", "n": {}} {"x": 1}', 'say {"x": 1}', "{}x}"]
    assert apply(spark, replies, verdict_object) == ['{"tag": "None", "n": {}}', '{"x": 1}', None]
