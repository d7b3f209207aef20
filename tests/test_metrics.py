import math

import pytest

from rankfold.operators import metrics as E
from rankfold.operators.retrieve import rank_within

RUN = [  # (qid, docid, rank)
    ("q1", "d1", 1), ("q1", "d2", 2), ("q1", "d3", 3), ("q1", "d4", 4), ("q1", "d5", 5), ("q1", "d6", 6),
    ("q2", "d1", 1), ("q2", "d2", 2),
    ("q3", "d2", 1), ("q3", "d1", 2),
    ("q4", "d1", 1),
]
QRELS = [  # levels 2,1,0,unjudged,1,0 for q1 plus one unretrieved relevant document
    ("q1", "d1", 2), ("q1", "d2", 1), ("q1", "d3", 0), ("q1", "d5", 1), ("q1", "d6", 0), ("q1", "d7", 1),
    ("q2", "d1", 0),                      # R = 0
    ("q3", "d1", 1), ("q3", "d9", 1),     # N = 0
    ("q5", "d1", 1),                      # not in the run
]
METRICS = ["map", "bpref", "P_5", "P_10", "ndcg_cut_5", "judged_5", "judged_10"]


def log2(x):
    return math.log(x) / math.log(2)


@pytest.fixture(scope="module")
def pq(spark):
    run = spark.createDataFrame(RUN, "qid string, docid string, rank int")
    qrels = spark.createDataFrame(QRELS, "qid string, docid string, rel int")
    rows = E.per_query(run, qrels, METRICS).collect()
    return {r.qid: r.asDict() for r in rows}


def test_query_set(pq):
    assert sorted(pq) == ["q1", "q2", "q3"]


def test_q1_by_hand(pq):
    q = pq["q1"]
    assert q["map"] == pytest.approx((1 / 1 + 2 / 2 + 3 / 5) / 4)
    assert q["P_5"] == pytest.approx(3 / 5)
    assert q["P_10"] == pytest.approx(3 / 10)
    assert q["judged_5"] == pytest.approx(4 / 5)
    assert q["judged_10"] == pytest.approx(5 / 10)
    dcg = 2 / log2(2) + 1 / log2(3) + 1 / log2(6)
    idcg = 2 / log2(2) + 1 / log2(3) + 1 / log2(4) + 1 / log2(5)
    assert q["ndcg_cut_5"] == pytest.approx(dcg / idcg)
    # R=4, N=2, m=2: d1 and d2 have no judged non-relevant above, d5 has one (d3)
    assert q["bpref"] == pytest.approx((1 + 1 + (1 - 1 / 2)) / 4)


def test_r_zero(pq):
    assert all(pq["q2"][m] == 0 for m in METRICS if not m.startswith("judged"))


def test_n_zero(pq):
    assert pq["q3"]["bpref"] == pytest.approx(1 / 2)
    assert pq["q3"]["map"] == pytest.approx((1 / 2) / 2)


def test_mean_over_query_set(spark, pq):
    run = spark.createDataFrame(RUN, "qid string, docid string, rank int")
    qrels = spark.createDataFrame(QRELS, "qid string, docid string, rel int")
    m = {r.metric: r for r in E.mean_metrics(E.eval_run(run, qrels, METRICS)).collect()}
    assert m["map"].n_queries == 3
    assert m["map"].value == pytest.approx(sum(pq[q]["map"] for q in pq) / 3)


def test_ideal_order_ndcg_is_one(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, docid string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 1)], "qid string, docid string, rel int")
    r = E.per_query(run, qrels, ["ndcg_cut_20", "map"]).first()
    assert r.ndcg_cut_20 == pytest.approx(1.0) and r.map == pytest.approx(1.0)


def test_ties_rank_by_docid_desc_as_string(spark):
    df = spark.createDataFrame([("q", "9", 1.0), ("q", "10", 1.0), ("q", "100", 1.0)], "qid string, docid string, score double")
    ranks = {r.docid: r.rank for r in rank_within(df).collect()}
    assert ranks == {"9": 1, "100": 2, "10": 3}
