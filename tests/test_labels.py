"""Judgments that grow with the corpus: broadcast pairs, level counts, samples without a sort."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.operators import benchmark as B
from rankfold.operators import crossval as CV
from rankfold.operators import metrics as E
from rankfold.operators.labels import labels_of


def judgments(spark, n=4000):
    rng = random.Random(3)
    rows = [(f"q{i % 3}", f"d{i}", rng.choice([0, 0, 1, 2])) for i in range(n)] + [("few", "d1", 2), ("few", "d2", None), (None, "d3", 1)]
    rows += [("same", "d1", 1)] * 900
    return spark.createDataFrame(rows, "qid string, docid string, rel int").repartition(4)


def place(spark, q):
    """(qid, docid) in the md5 order of their query, by brute force."""
    o = q.withColumn("o", F.md5(F.concat_ws("|", F.lit("42"), "qid", "docid"))).collect()
    out = {}
    for r in o:
        if r.qid is not None:
            out.setdefault(r.qid, []).append((r.o, r.docid))
    return {k: [d for _, d in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("rate", [0.1, 0.5, 0.9])
def test_samples_take_the_first_of_the_order(spark, rate):
    q = judgments(spark)
    got = {}
    for r in B.sample_shallow(q, rate).collect():
        got.setdefault(r.qid, []).append(r.docid)
    for qid, docs in place(spark, q).items():
        n = max(1, int(rate * len(docs) + 0.5))
        assert sorted(got[qid]) == sorted(docs[:n])


def test_few_judgments_are_sorted(spark, monkeypatch):
    q = judgments(spark, 40_000).filter("qid <> 'same'")
    sorted_rows = []
    real = B.sequence_number
    monkeypatch.setattr(B, "sequence_number", lambda df, *a: sorted_rows.append(df.count()) or real(df, *a))
    folds = B.make_folds(spark.createDataFrame([(f"q{i}", i) for i in range(3)], "qid string, ord long"), 3)
    g = B.sample_grid(q, folds, B.RATES, B.MODES, 42, 9)
    assert g.filter("mode = 'shallow' and rate = 1.0").count() == 2 * q.filter("qid <> 'few'").count()
    assert 0 < sum(sorted_rows) < 0.05 * q.count()


def test_the_grid_multiplies_counts_or_the_runs_judgments(spark):
    q = judgments(spark)
    folds = B.make_folds(spark.createDataFrame([(f"q{i}", i) for i in range(3)] + [("q1", 1)], "qid string, ord long"), 3)
    rows = B.sample_grid(q, folds, B.RATES, B.MODES, 42, 12)
    counted = B.sample_grid(q, folds, B.RATES, B.MODES, 42, 12, counted=["rel"])
    cell = ["mode", "rate", "set_name", "fold", "split", "qid"]
    want = {tuple(r) for r in rows.groupBy(*cell, "rel").count().collect()}
    assert {tuple(r) for r in counted.groupBy(*cell, "rel").sum("n").collect()} == want and want
    assert counted.count() < 0.2 * rows.count()
    run = q.filter("docid like '%7'").select("qid", "docid")
    numbered = B.numbered_judgments(q, B.RATES, 42)
    mine = B.sample_grid(q, folds, B.RATES, B.MODES, 42, 12, numbered, run)
    columns = [*cell, "docid", "rel"]
    wanted = labels_of(run, rows)
    assert sorted(map(str, mine.select(*columns).collect())) == sorted(map(str, wanted.select(*columns).collect()))
    assert 0 < mine.count() < rows.count()


def test_judgments_are_read_where_they_lie(spark):
    q = judgments(spark)
    run = spark.createDataFrame([("q0", "d0", 1), ("q1", "d1", 1), ("q1", "none", 2)], "qid string, docid string, rank int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = labels_of(run, q)
        plan = labels._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r.qid, r.docid) for r in labels.collect()) == [("q0", "d0"), ("q1", "d1")]


def test_ideal_from_level_counts(spark):
    q = judgments(spark)
    got = {r.qid: r for r in E.ideal_dcg(q, [3, 20]).collect()}
    by = {}
    for r in q.collect():
        if r.rel is not None and r.rel > 0:
            by.setdefault(r.qid, []).append(r.rel)
    for qid, rels in by.items():
        rels.sort(reverse=True)
        for k in (3, 20):
            want = sum(x / math.log2(i + 2) for i, x in enumerate(rels[:k]))
            assert got[qid][f"idcg_{k}"] == pytest.approx(want)
    assert "rel" in q.columns and isinstance(E.judged_levels(q).schema["n"].dataType, T.LongType)


def counted_calls(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append((a, k)) or real(*a, **k))
    return calls


def fold_case(spark):
    q = judgments(spark).filter("qid <> 'same' and rel is not null")
    folds = B.make_folds(spark.createDataFrame([(f"q{i}", i) for i in range(3)], "qid string, ord long"), 3)
    run = spark.createDataFrame([(f"q{i % 3}", f"d{i}", 1.0 / (i + 1), i // 3 + 1) for i in range(90)], "qid string, docid string, score double, rank int")
    return q, folds, run


def test_one_set_of_judgments_for_both_splits_is_counted_once(spark, monkeypatch):
    q, folds, run = fold_case(spark)
    want = {tuple(r) for r in CV.fold_metrics(run, folds, q, q).collect()}
    calls = counted_calls(monkeypatch, E, "judged_levels")
    got = CV.fold_metrics(run, folds, q.limit(0), q, dev_qrels="full")
    assert {tuple(r) for r in got.collect()} == want and len(want) == 2 * 3 * len(E.DEFAULT_METRICS)
    assert len(calls) == 1


def test_levels_once_and_the_runs_judgments_give_the_same_means(spark):
    q, folds, run = fold_case(spark)
    levels, few = E.judged_levels(q), labels_of(run, q)
    assert few.count() == 90
    rows = lambda d: {tuple(r) for r in d.collect()}
    assert rows(E.eval_run(run, few, levels=levels)) == rows(E.eval_run(run, q))
    assert rows(CV.fold_metrics(run, folds, q, few, full_levels=levels)) == rows(CV.fold_metrics(run, folds, q, q))


def test_a_set_of_judgments_meets_only_the_pairs_it_judges(spark, monkeypatch):
    q, folds, run = fold_case(spark)
    tagged = B.split_run(run.select("qid", "docid"), folds)
    calls = counted_calls(monkeypatch, B, "labels_of")
    got = B.qrels_for_split(tagged, q.filter("rel = 2"), q).collect()
    assert [sorted({r.split for r in a[0].select("split").collect()}) for a, _ in calls] == [["dev", "train"], ["test"]]
    rel = {(r.qid, r.docid): r.rel for r in q.collect()}
    assert len(got) == 270
    for r in got:
        known = rel[r.qid, r.docid]
        assert r.rel == (known if r.split == "test" or known == 2 else None)


def test_the_sample_of_a_stream_is_not_written(spark, monkeypatch):
    """It is read once, by the labels of the training run."""
    from rankfold.plans import queries  # noqa: F401  (all tables of the SQL)
    from rankfold.plans import q_trainlog as Q

    calls = counted_calls(monkeypatch, Q, "checkpoint")
    monkeypatch.setattr(Q, "X", lambda *a: type("Few", (), {"qrels": judgments(spark, 30)}))
    monkeypatch.setattr(Q, "_train_run", lambda x: spark.createDataFrame([("s1", "q0", f"d{i}") for i in range(30)], "fold string, qid string, docid string"))
    monkeypatch.setattr(Q, "sample_stream", lambda spark, source: source.queries)
    assert Q.q_sample_stream(spark, "").count() == 1 and not calls
