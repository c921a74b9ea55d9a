"""The queries over training text that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from skein.llm import oracle, queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(D + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    found = con.execute(oracle.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect()) == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in oracle.SQL))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, D)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
