"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

from popgraph import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v + 1e-9:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
