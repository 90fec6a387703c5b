"""Every registered query against its SQL on the smallest data set."""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from usemeter.plans.oracle import ORACLE
from usemeter.plans.suite import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["repo_key", "tag", "backbone", "score", "pipelines_called", "pipelines_total"]
    assert df.count() == spark.read.parquet(f"{SF_DIR}/customer.parquet").count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_flagship_counts(spark):
    rows = queries()["evaluate_score"](spark, "/root/testdata/sf0.01").groupBy(
        "tag", "backbone").count().collect()
    assert {tuple(r) for r in rows} == {
        ("Significant", "Yes", 764), ("Significant", "Partial", 99), ("Moderate", "Yes", 136),
        ("Moderate", "Partial", 13), ("Less", "No", 68), ("None", "No", 420)}
