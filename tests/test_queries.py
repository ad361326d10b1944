"""Every registered query against its reference SQL."""

from __future__ import annotations

import pytest
from compare import assert_same, duck
from conftest import SF_DIR

import __spark_entry__ as entry_points
from candlewick.oracle import ORACLE_SQL
from candlewick.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_points_hold_every_query():
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE_SQL.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_reference_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(got) > 0
    assert_same(got, con.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and {"k", "d", "j", "obv", "psar"} <= set(df.columns)
