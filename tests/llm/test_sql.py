"""The registered training-data queries against their SQL."""

import glob
import os

import duckdb
import pytest

from shardlake.llm import queries

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
