"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from bazaarlens.plans import catalog

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, str):
        return v
    return float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    rows = catalog.queries()[name](spark, AT)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want and got
    assert os.path.exists(AT)
