"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from slotwise.plans.oracles import ORACLES
from slotwise.plans.queries import QUERIES
from tests.oracle import connect, spark_rows, spark_types, sql_rows, sql_types

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert spark_types(df) == sql_types(con, ORACLES[name])
    given, wanted = spark_rows(df), sql_rows(con, ORACLES[name])
    assert given[0] == wanted[0]
    assert len(given[1]) == len(wanted[1])
    assert given[1] == wanted[1]


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["user_id", "event_count", "year", "month", "day"]
