"""Every query against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as e
from loreweave.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(9)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or isinstance(x, float) and np.isnan(x) else str(x))
    return list(df.columns), sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    for c in got.columns:
        if c in want and got[c].dtype != want[c].dtype and got[c].dtype != object and want[c].dtype != object:
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert e.entry(spark).count() > 0 and set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
