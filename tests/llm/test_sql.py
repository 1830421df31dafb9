"""Queries of the subpackage that SQL can express, against DuckDB on the smallest tables."""

import pytest

from inkgauge.llm import queries
from tests.test_catalog import duck, plain  # noqa: F401 - a fixture


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, sf_dir, name):  # noqa: F811
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = duck.sql(queries.SQL[name])
    assert columns == sorted(expected.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    assert rows and rows == sorted(tuple(plain(v) for v in r) for r in expected.project(", ".join(columns)).fetchall())
