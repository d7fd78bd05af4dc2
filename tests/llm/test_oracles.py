"""The queries of the subpackage against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda pdf: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
