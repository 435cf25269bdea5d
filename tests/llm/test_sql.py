"""Every query of the subpackage that has an SQL twin against DuckDB, on small tables."""

import os

import duckdb
import pytest

from loreweave.llm.queries import QUERIES, SQL

TABLES = "documents pages benchmark conversations embeddings".split()


def rows(df):
    names = sorted(df.columns)
    out = []
    for row in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None):
        out.append(tuple(round(float(x), 9) if isinstance(x, float) and x != int(x) else int(x) if isinstance(x, float) else x for x in row))
    return names, sorted(map(str, out))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, sf):
    duck = duckdb.connect()
    for t in TABLES:
        p = f"/root/testdata/{sf}/{t}.parquet"
        duck.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got, want = rows(QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()), rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b] == []
