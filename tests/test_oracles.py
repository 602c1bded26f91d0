"""Every registered query against its SQL oracle."""

import pytest

import __spark_entry__ as entry
from spanloom.workload import oracles, queries as registered
from tests.compare import mismatch, oracle_connection

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_an_oracle():
    assert set(registered.REGISTRY) == set(oracles.ORACLES) and set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert mismatch(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["callee_id", "n_calls"] and df.count() > 0
