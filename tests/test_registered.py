"""Registered queries against their SQL, and the driver's entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from check_oracle import compare, database
from tollbook.plans.oracle import all_oracles
from tollbook.plans.registered import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", all_queries())
def test_query_equals_its_sql(spark, connection, name):
    query, sql = all_queries()[name], all_oracles()[name]
    assert compare(spark, connection, SF_DIR, query, sql) == []
