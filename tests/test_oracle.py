"""Every query against its oracle SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from pagemill.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    for t in ("pages", "documents", "events", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(repr(r[i]) for i in at) for r in found))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_oracle(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DATA)
    expected = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_oracle(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
