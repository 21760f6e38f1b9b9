"""Registered queries of the subpackage against their SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from slotwise.llm.oracles import ORACLES
from slotwise.llm.queries import QUERIES
from tests.oracle import connect, spark_rows, spark_types, sql_rows, sql_types

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_operators_and_the_pipeline_are_registered():
    given = entry_points.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(given)
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = connect(SF_DIR)
    df = QUERIES[name](spark, SF_DIR)
    assert spark_types(df) == sql_types(con, ORACLES[name])
    assert spark_rows(df) == sql_rows(con, ORACLES[name])
