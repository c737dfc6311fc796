"""Every registered query against its SQL (TEST_SF_DIR chooses the scale)."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_every_query_has_sql():
    """But for those of the training-data part that SQL cannot express: its own tests compare them with plain versions."""
    assert all(name.startswith("op") or name == "pipeline" for name in set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    difference, _, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert difference is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["column"] for r in rows} == {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"}
