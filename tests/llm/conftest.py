import duckdb
import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) tuples; shorter ones are filled with nulls."""

    def make(rows, extra=""):
        width = 4 + extra.count(",") * 1
        filled = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(filled, "doc_id bigint, text string, lang string, source string" + extra)

    return make


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con
