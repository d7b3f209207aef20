from pyspark.sql import functions as F

from rankfold.operators import benchmark as B
from rankfold.operators import crossval as CV


def topic_ids(spark, n):
    return spark.createDataFrame([(str(100 + i), i) for i in range(n)], "qid string, ord long")


def test_folds_partition(spark):
    f = B.make_folds(topic_ids(spark, 23), 5).collect()
    by_fold = {}
    for r in f:
        by_fold.setdefault(r.fold, {}).setdefault(r.split, set()).add(r.qid)
    assert sorted(by_fold) == ["s1", "s2", "s3", "s4", "s5"]
    tests = [by_fold[k]["test"] for k in sorted(by_fold)]
    assert set().union(*tests) == {str(100 + i) for i in range(23)}
    assert sum(len(t) for t in tests) == 23
    for i, k in enumerate(sorted(by_fold, key=lambda s: int(s[1:]))):
        prev = f"s{5 if i == 0 else i}"
        assert by_fold[k]["dev"] == by_fold[prev]["test"]
        s = by_fold[k]
        assert not (s["train"] & s["dev"]) and not (s["train"] & s["test"]) and not (s["dev"] & s["test"])


def test_select_folds_is_a_list(spark):
    f = B.make_folds(topic_ids(spark, 10), 5)
    got = {r.fold for r in B.select_folds(f, "s1-s3").collect()}
    assert got == {"s1", "s3"}


def test_deep_sample_counts(spark):
    f = B.make_folds(topic_ids(spark, 50), 5)
    s = B.sample_deep(f, 0.1, 42)
    counts = {(r.fold, r.split): r.n for r in s.groupBy("fold", "split").agg(F.count("*").alias("n")).collect()}
    full = {(r.fold, r.split): r.n for r in f.groupBy("fold", "split").agg(F.count("*").alias("n")).collect()}
    for k, n in full.items():
        if k[1] == "test":
            assert counts[k] == n
        else:
            assert counts[k] == max(1, round(0.1 * n))
    assert B.sample_deep(f, 1.0, 42).count() == f.count()


def test_shallow_sample_minimum_one(spark):
    q = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 0), ("a", "d3", 1), ("b", "d1", 1)],
                              "qid string, docid string, rel int")
    s = {r.qid: r.n for r in B.sample_shallow(q, 0.1, 42).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert s == {"a": 1, "b": 1}


def test_check_benchmark_finds_problems(spark):
    folds = spark.createDataFrame([("s1", "test", "1"), ("s1", "train", "1"), ("s2", "test", "1")],
                                  "fold string, split string, qid string")
    qrels = spark.createDataFrame([("9", "d", 1)], "qid string, docid string, rel int")
    topics = spark.createDataFrame([("1",), ("2",)], "qid string")
    checks = {(r.check, r.qid) for r in B.check_benchmark(folds, qrels, topics).collect()}
    assert checks == {("split_overlap", "1"), ("test_repeated", "1"), ("test_missing", "2"),
                      ("unjudged_topic", "1"), ("unjudged_topic", "2"), ("unknown_qrels_qid", "9")}


def test_union_test_later_fold_wins(spark):
    runs = spark.createDataFrame([("s1", "q", "d", 1.0), ("s2", "q", "d", 5.0), ("s10", "q", "d", 3.0)],
                                 "fold string, qid string, docid string, score double")
    assert CV.union_test(runs).first().score == 3.0


def test_cv_ready_gate(spark):
    folds = spark.createDataFrame([("s1", "test", "a"), ("s2", "test", "b")], "fold string, split string, qid string")
    runs = spark.createDataFrame([("s1", "a", "d", 1.0)], "fold string, qid string, docid string, score double")
    assert CV.cv_ready(runs, folds).count() == 0
    runs2 = runs.unionByName(spark.createDataFrame([("s2", "b", "d", 1.0)], runs.schema))
    assert CV.cv_ready(runs2, folds).count() == 2


def test_interpolation_weight_one_is_searcher_order(spark):
    folds = spark.createDataFrame([("s1", "dev", "q"), ("s1", "test", "t")], "fold string, split string, qid string")
    search = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("t", "a", 3.0), ("t", "b", 1.0)],
                                   "qid string, docid string, score double")
    rerank = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 1.0), ("t", "a", 0.0), ("t", "b", 1.0)],
                                   "qid string, docid string, score double")
    qrels = spark.createDataFrame([("q", "a", 1), ("t", "a", 1)], "qid string, docid string, rel int")
    out = CV.interpolate(search, rerank, folds, qrels, qrels, "map", ["map"]).collect()
    assert len(out) == 1
    r = out[0]
    assert r.weight > 0.5 and r.value == 1.0 and r.dev_value == 1.0
