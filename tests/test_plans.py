"""Every query with SQL is compared with DuckDB over the smallest tables; the rest have rows."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from quarry import plans

from .conftest import SMALL

#: queries whose SQL alone takes long
SLOW = {"ded3_near_pairs"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str, datetime.datetime)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if math.isnan(v) else round(float(v), 5)


def table(rows):
    return sorted(([plain(v) for v in r] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-5, rel_tol=1e-9))


@pytest.mark.parametrize("name", sorted(set(plans.ORACLE_SQL) - SLOW))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    result = duck.execute(plans.ORACLE_SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    ours = table(tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect())
    other = table([tuple(r[i] for i in at) for r in result.fetchall()])
    assert len(ours) == len(other) and all(close(a, b) for r, s in zip(ours, other) for a, b in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_have_rows(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0
