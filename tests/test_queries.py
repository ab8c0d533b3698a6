"""Every registered query of this package against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillmeter.plans import log_queries, record_queries, testdata

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = testdata.queries() | record_queries.queries() | log_queries.queries(), testdata.oracle_sql() | record_queries.oracle_sql() | log_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())
