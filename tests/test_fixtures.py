"""The fixtures as Spark's tables."""

import pytest

from pagemill.plans import fixtures as fx

FIXTURES = {k: v for k, v in vars(fx).items() if isinstance(v, fx.Fixture)}


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_a_fixture_lies_in_the_plan(spark, name):
    """Rows, names and types are those given, and no Python worker reads them."""
    fixture = FIXTURES[name]
    df = fixture.df(spark)
    want = spark.createDataFrame(fixture.rows, fixture.schema)
    assert df.dtypes == want.dtypes and all(f.nullable for f in df.schema)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, want.collect()))
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
