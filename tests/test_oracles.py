"""Every query with SQL gives what the SQL gives, at the smallest size."""

import glob
import os

import duckdb
import numpy as np
import pytest

from quirel.plans import catalogue

DATA = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = Q[name](spark, DATA)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    ours = sorted(repr(tuple(map(norm, r))) for r in df.collect())
    theirs = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert ours == theirs
