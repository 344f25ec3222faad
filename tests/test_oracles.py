"""Every query with SQL gives the same rows in Spark and DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vellum.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, db, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    r = db.execute(registry.ORACLE[name])
    names = [d[0] for d in r.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in at] == columns
    assert sorted(tuple(map(plain, x)) for x in df.select(*columns).collect()) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, DIR).collect()
    assert rows and len({r.__fields__ == rows[0].__fields__ for r in rows}) == 1
