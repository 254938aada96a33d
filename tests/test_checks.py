"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import database, difference

SMALL = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"transaction_type", "transaction_count", "avg_risk_score"}


def test_every_sql_has_a_query():
    assert SQL.keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, SMALL), con, SQL[name]) is None


def test_default_share_finds_nine_of_ten(spark):
    queries = contract.queries()
    near = {(r["query_id"], r["id"]) for r in queries["ivf_topk"](spark, SMALL).collect()}
    exact = {(r["query_id"], r["id"]) for r in queries["vector_topk"](spark, SMALL).collect()}
    assert len(near & exact) / len(exact) >= 0.9
    assert queries["ivf_recall"](spark, SMALL).first()["reached"] == 1
