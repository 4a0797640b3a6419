"""Queries over spans against their SQL on line items with nulls and fractions; no two spans of a file are equal, as the SQL leaves their order open."""

import duckdb
import pytest

from pagemill.plans import catalog

ROWS = [
    (1, 10, 1, 5.0), (1, 12, 2, 9.0), (1, None, 1, 400.0), (1, 30, None, 2.0), (1, 40, 1, None),  # a null start is the file's last span
    (2, None, 1, 3.0), (2, 450, 2, 3.0), (3, 7, 1, None), (3, 20, 1, 4.0), (3, 20, 2, None),
    (4, 3, 1, 2.5), (4, 6, 2, 1.0), (5, 3, 1, 3.5), (5, 6, 2, 1.0), (6, 3, 1, 2.6), (6, 6, 2, 1.0),
    (None, 1, 1, 1.0), (None, 9, 2, 1.0), (7, 1, 3, 1.0), (8, None, None, None), (9, 4, None, 5.0), (9, 4, 1, 5.5),
]


@pytest.mark.parametrize("name", ["interval_islands", "covered_characters", "outermost_spans"])
def test_spans_equal_sql_on_odd_rows(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
