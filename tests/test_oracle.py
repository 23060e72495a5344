"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from castgraph.plans import reference


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_same_rows(spark, small, con, name):
    got = reference.QUERIES[name](spark, small)
    cols = sorted(got.columns)
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({reference.SQL[name]})")
    want = Counter(tuple(plain(v) for v in r) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.SQL) - {"word2vec_vectors"}))
def test_other_queries_run(spark, small, name):
    assert reference.QUERIES[name](spark, small).count() > 0
