"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from comparison import connect, differences
from conftest import SF_DIR
from ebbline.plans import oracles
from ebbline.plans import queries as registered

QUERIES, ORACLES = registered.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, database, name):
    assert differences(QUERIES[name](spark, SF_DIR), database, ORACLES[name]) == ""


def test_contract_holds_them():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 12
    assert rows == sorted(rows, key=lambda r: (-r["revenue_at_risk"], r["customerID"]))
