"""Every registered query that has SQL gives the same rows in Spark and DuckDB."""

from pathlib import Path

import duckdb
import pytest

from workload import QUERIES, SQL

TABLES = ["documents", "pages", "events", "labels"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    if not Path(sf).exists():
        pytest.skip("no test data")
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
