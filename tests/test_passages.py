from pyspark.sql import functions as F

from rankfold.operators import rerank as K


def docs(spark, sizes):
    rows = [(f"d{n}", [f"w{i}" for i in range(n)]) for n in sizes]
    return spark.createDataFrame(rows, "docid string, tokens array<string>")


SIZES = [0, 1, 149, 150, 151, 225, 226, 5000]


def test_passage_counts_capped(spark):
    p = K.passages(docs(spark, SIZES), numpassages=K.REFERENCE_NUM_PASSAGES)
    got = {r.docid: r.n for r in p.groupBy("docid").agg(F.count("*").alias("n")).collect()}
    assert [got[f"d{n}"] for n in SIZES] == [1, 1, 1, 1, 2, 2, 3, 30]


def test_passages_cover_whole_text(spark):
    p = K.passages(docs(spark, SIZES))
    got = p.groupBy("docid").agg(F.count("*").alias("n"), F.max(F.col("start") + F.size("ptokens")).alias("end"),
                                 F.min("pidx").alias("lo"), F.max("pidx").alias("hi")).collect()
    by = {r.docid: r for r in got}
    assert by["d5000"].n == 66 and by["d5000"].end == 5000
    for n in SIZES:
        r = by[f"d{n}"]
        assert r.end == n and r.lo == 0 and r.hi == r.n - 1


def test_windows_and_stride(spark):
    p = K.passages(docs(spark, [226])).orderBy("pidx").collect()
    assert [(r.start, len(r.ptokens)) for r in p] == [(0, 150), (75, 150), (150, 76)]
    assert p[1].ptokens[0] == "w75"


def test_subsample_keeps_first(spark):
    p = K.passages(docs(spark, [5000]))
    s = K.subsample_passages(p, 0.1, 42)
    pids = [r.pidx for r in s.collect()]
    assert 0 in pids and len(pids) < 66


def test_aggregations_order(spark):
    rows = [("q", "d", 0, 1.0), ("q", "d", 1, 3.0), ("q", "d", 2, 2.0)]
    s = spark.createDataFrame(rows, "qid string, docid string, pidx int, score double")
    r = K.aggregate_scores(s).first()
    assert (r.score_first, r.score_max, r.score_sum, r.score_avg) == (1.0, 3.0, 6.0, 2.0)
    assert r.score_first <= r.score_max <= r.score_sum


def test_bm25_passage_score(spark):
    df = spark.createDataFrame(
        [([("a", 1.5), ("b", 0.5)], ["a", "x", "a", "b"]), (None, ["a"]), ([], ["a"])],
        "qterms array<struct<term:string,qw:double>>, ptokens array<string>")
    got = [r[0] for r in df.select(K.bm25_passage_score(F.col("qterms"), F.col("ptokens"))).collect()]
    norm = 0.9 * (0.6 + 0.4 * 4 / 150)
    assert abs(got[0] - (1.5 * 2 / (2 + norm) + 0.5 * 1 / (1 + norm))) < 1e-12
    assert got[1:] == [0.0, 0.0]  # a query without terms


def test_batch_scorer_loads_its_model_once_per_worker(spark, tmpdir_path):
    import os

    import pandas as pd

    from rankfold.operators import rerank as K

    def load(folder=tmpdir_path):
        name = os.path.join(folder, f"load-{os.getpid()}")
        assert not os.path.exists(name)  # a second load in one worker would fail here
        open(name, "w").close()
        return 10.0

    def predict(model, a, b):
        return pd.Series(a) * model + b

    pairs = spark.range(4000).selectExpr("id", "cast(id as double) as a", "1.0D as b").repartition(16)
    scored = K.score_passages(pairs, K.batch_scorer(load, predict, ["a", "b"], f"test-{tmpdir_path}"))
    assert all(r.score == 10 * r.a + 1 for r in scored.collect())
    assert scored.filter("score > 5").count() == 3999
    assert 1 <= len(os.listdir(tmpdir_path)) <= 16
