"""Every query runs over the smallest tables; those with SQL give its rows."""

import glob
import os

import duckdb
import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES


def canon(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, bool) or isinstance(v, str):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None)
    return sorted((tuple(canon(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
