"""Queries with SQL give its rows on the smallest tables."""

import os
from collections import Counter

import pytest

from pointloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    res = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = Counter(tuple(r[cols.index(c)] for c in sorted(cols)) for r in res.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(r[c] for c in sorted(cols)) for r in df.collect()) == want
