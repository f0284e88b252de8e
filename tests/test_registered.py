"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tessella import queries as own
from tests.compare import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query(spark, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = sql_rows(sf_dir, own.ORACLES[name])
    assert columns == want_columns
    assert rows == want


def test_all_have_sql():
    assert set(own.QUERIES) == set(own.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
