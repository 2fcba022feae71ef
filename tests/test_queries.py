"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from pipegrid.plans import registry

FOLDER = Path("/root/testdata/sf0.001")


def _plain(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _names():
    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, oracle, name):
    df = registry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    cur = oracle.execute(registry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == columns
    want = sorted(tuple(_plain(r[at.index(c)]) for c in columns) for r in cur.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == want


def test_flagship(spark):
    got = registry.flagship(spark, str(FOLDER)).collect()
    assert got and all(r["n"] >= r["ok"] for r in got)
