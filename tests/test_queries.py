"""Every query of the screening operators against its DuckDB SQL; those without SQL give rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from sieveline.plans.operations import ORACLE_SQL, QUERIES

from .conftest import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, data, duck, name):
    got, expected = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_and_catalogue(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
