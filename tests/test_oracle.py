"""Every registered query against its DuckDB SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as ENTRY
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ENTRY.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = ENTRY.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ENTRY.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert df.columns == ["qid", "ndcg_cut_20"]
    assert len(rows) > 0
