"""Operator 9 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.llm import ann, q_vectors


def brute(rows, queries, k=5):
    ok = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok], dtype=np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        for i in np.flatnonzero(ids == q):
            cos = (x * x[i]).sum(1) / (norm[i] * norm)
            for j in np.flatnonzero(ids != q):
                out[q, ids[j]] = max(out.get((q, ids[j]), -2), cos[j])
    best = {}
    for (q, j), s in out.items():
        best.setdefault(q, []).append((-s, j))
    return {q: [(j, -s) for s, j in sorted(v)[:k]] for q, v in best.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_op9_recall_and_exact_scores(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = found(q_vectors.op9_ann(spark, d))
    assert got.keys() == want.keys()
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 5
        for j, s in near:
            a, b = vec[q], vec[j]
            assert s == (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


def test_op9_hot_vector_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(200)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(100)]
    rows += [(1000, None), (1001, []), (1002, [0.0, 0.0, 0.0]), (1003, [1.0, None, 2.0]), (1004, [1.0, math.nan, 0.0]),
             (1005, [math.inf, 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (50, [1.0, 0.5, 0.0]), (7, [0.0, 1.0, 0.0]),
             (1050, [2.0, 1.0, 0.0]), (1100, [-0.0, 3.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    queries = df.filter(F.col("vec_id") % 50 == 0).select("vec_id")
    want = brute(rows, sorted({r.vec_id for r in queries.collect()}))
    got = found(ann.nearest(df, queries))
    assert got == want


def test_op9_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert ann.nearest(one, one.select("vec_id")).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(two, two.select("vec_id").limit(1)).collect()] == [(0, 1, 3)]
    none = spark.createDataFrame([], schema)
    assert ann.nearest(none, none.select("vec_id")).count() == 0


def test_op9_one_id_with_many_vectors(spark):
    rng = np.random.default_rng(5)
    # id 7 owns a third of the rows, all of them near the queries; others share its vectors
    rows = [(7, [1.0, 0.01 * i, 0.0]) for i in range(1, 101)] + [(7, [0.0, 1.0, 0.0]), (50, [1.0, 0.0, 0.0])]
    rows += [(100 + i, [1.0, 0.01 * (i + 1), 0.0]) for i in range(3)]
    rows += [(200 + i, rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = df.filter(F.col("vec_id").isin(7, 50, 100, 250, 300)).select("vec_id").distinct()
    want = brute(rows, sorted({r.vec_id for r in queries.collect()}))
    got = found(ann.nearest(df, queries))
    assert all(len(v) == 5 for v in got.values())
    assert got == want


def test_op9_groups_are_bounded(spark, monkeypatch):
    # one leaf with 1,000 rows is split, the small ones beside it are not
    assert ann.sub_blocks(np.array([1000.0, 10, 20, 5]), 3, 100).tolist() == [11, 1, 1]
    rng = np.random.default_rng(6)
    # many sub-blocks and chunks give the same rows as one
    rows = [(i, rng.normal(size=3).tolist()) for i in range(300)] + [(300 + i, [3.0 * i, 1.0 * i, -7.0 * i]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 7)
    queries = df.filter(F.col("vec_id") % 10 == 0).select("vec_id")
    assert found(ann.nearest(df, queries)) == brute(rows, range(0, 500, 10))
