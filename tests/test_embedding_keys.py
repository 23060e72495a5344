"""Every stored vector is used, however many there are: the SQL of the queries with the table's size in place of its fixed 500."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from castgraph.plans import reference
from test_oracle import plain

SIZE = 1300


@pytest.fixture(scope="module")
def tables(small, tmp_path_factory):
    d = tmp_path_factory.mktemp("embeddings")
    vec = np.random.default_rng(4).standard_normal((SIZE, 8)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(SIZE), "embedding": vec.tolist()}), d / "embeddings.parquet")
    pq.write_table(pq.read_table(f"{small}/events.parquet"), d / "events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["adjacent_speech_cosine_sum", "metric_difference", "metric_compare_wide", "scatter_frame", "trend_line", "diff_bar"])
def test_vectors_beyond_500(spark, tables, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got = reference.QUERIES[name](spark, tables)
    cols = sorted(got.columns)
    sql = reference.SQL[name].replace("% 500", "% (SELECT count(*) FROM embeddings)")
    want = sorted(map(str, (tuple(plain(v) for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())))
    assert want and sorted(str(tuple(plain(r[c]) for c in cols)) for r in got.collect()) == want
