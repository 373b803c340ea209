"""Every query that has SQL against DuckDB over the smallest tables; the others run."""

import duckdb
import pytest

from tidewatch.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in catalogue.ORACLES:
        wanted = duck.sql(catalogue.ORACLES[name])
        assert sorted(wanted.columns) == columns
        assert got == plain(wanted.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
