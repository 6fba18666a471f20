"""The driver's contract: every query runs and matches its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tacet.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "is_finite") or isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    out = entry.queries()[name](spark, DIR)
    rows = sorted(tuple(map(plain, r)) for r in out.collect())
    if name in entry.oracle_sql():
        want = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(out.columns)
        at = [names.index(c) for c in out.columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
