"""Every registered query equals its oracle SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck
from tidemark.plans import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry(spark)
    assert df.columns == ["event_id", "user_id", "paid", "value"]
    assert df.count() > 0
