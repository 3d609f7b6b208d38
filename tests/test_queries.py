"""Every query that has SQL, held against it on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from offerloom.plans import queries as Q
from offerloom.plans import exchange, listed, selected, surface  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 7)
    return x if isinstance(x, (bool, int)) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.ORACLE])
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    rel = con.sql(Q.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(*columns).fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE])
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
