"""Every query with oracle SQL against DuckDB on the smallest tables, and the driver's entry points."""

import glob
import os

import duckdb
import pytest

from millrace.plans import catalog, exchange, streams  # noqa: F401  (exchange and streams add their queries to the catalog)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return round(float(x), 6)
    return int(x) if hasattr(x, "__int__") and not isinstance(x, str) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs_twice_alike(spark, name):
    first, again = (rows(catalog.QUERIES[name](spark, SF).toPandas()) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 36
    assert set(e.oracle_sql()) <= set(e.queries())
