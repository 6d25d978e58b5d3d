"""Every registered query against its SQL on the test tables."""

from __future__ import annotations

import os

import __spark_entry__ as contract
import pytest
from oracle_check import compare, connect

from salesledger.plans.catalog import QUERIES
from salesledger.plans.oracle import ORACLE_SQL

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.items() <= contract.queries().items() and ORACLE_SQL.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, connection, name):
    rows, problems = compare(QUERIES[name](spark, FOLDER), connection, ORACLE_SQL[name])
    assert not problems
    if name != "orphan_orders":
        assert rows > 0


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.bucket for r in rows] == list(range(1, 32))
    assert sum(r.pcs for r in rows) == rows[0].total_pcs > 0
