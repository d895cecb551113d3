import pytest

import __spark_entry__ as contract
from roadsky.catalog.queries import QUERIES
from check_oracles import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(set(contract.oracle_sql()) & set(QUERIES)) >= len(QUERIES) - 2


def test_entry(spark):
    assert contract.entry(spark).count() == 4


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR) == ""
