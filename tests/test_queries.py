"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import SF_DIR, compare, oracle_connection

import __spark_entry__ as entry_point
from hodos.oracles import ORACLES
from hodos.registry import QUERIES


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"gbt_metrics"}


def test_entry(spark):
    assert entry_point.entry(spark).count() == 30


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, oracle, name):
    ok, detail = compare(spark, name, QUERIES[name], ORACLES[name], oracle, SF_DIR)
    assert ok, detail


def test_boosted_trees_run(spark):
    row = QUERIES["gbt_metrics"](spark, SF_DIR).first()
    assert row.n_rows > 0 and row.mae > 0
