"""Every registered query against its SQL twin, on whole tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check import compare
from millrace.coverage import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, base, name):
    found = contract.queries()[name](spark, SF).toPandas()
    assert name in contract.oracle_sql()
    assert compare(found, base.execute(contract.oracle_sql()[name]).df()) == "ok"


@pytest.mark.parametrize(
    "name", ["win_rank", "win_lag_lead", "win_running_sum", "win_range_frame", "session_agg", "join_asof"]
)
def test_query_with_split_groups(spark, base, hot, name):
    found = contract.queries()[name](spark, SF).toPandas()
    assert compare(found, base.execute(contract.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["event_id", "user_id", "event_type", "value"] and result.count() > 0
