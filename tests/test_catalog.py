"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from inkgauge.plans import catalog


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.6g}"
    return str(list(value)) if hasattr(value, "__len__") and not isinstance(value, str) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    wanted = sorted(tuple(plain(v) for v in r) for r in expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert rows == wanted


def test_flagship(spark, sf_dir):
    df = catalog.flagship(spark, sf_dir)
    assert "ratio" in df.columns and all(0 <= r.ratio <= 1 and math.isfinite(r.gain) for r in df.collect())
