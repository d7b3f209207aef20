"""The sample stream and the training by epochs, against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from rankfold.operators import samples as S
from rankfold.operators import trainlog as G
from rankfold.operators import training as TR


def md5(*parts):
    return hashlib.md5("|".join(map(str, (42, *parts))).encode()).hexdigest()


def make(spark):
    rng = random.Random(2)
    run, qrels = [], []
    for fold in ("s1", "s2"):
        for q in range(6):
            qid = f"{fold}q{q}"
            # one query holds most documents; one has no positive, one no negative
            n = 60 if q == 0 else rng.randint(2, 5)
            for d in range(n):
                run.append((fold, qid, f"d{d:03d}"))
                if q == 4 or (q != 3 and d % 2):
                    qrels.append((qid, f"d{d:03d}", 1))
                elif d % 3 == 0:
                    qrels.append((qid, f"d{d:03d}", 0))
    return (run, qrels, spark.createDataFrame(run, "fold string, qid string, docid string"),
            spark.createDataFrame(qrels, "qid string, docid string, rel int"))


def brute_stream(run, qrels, end):
    good = {(q, d) for q, d, r in qrels if r >= 1}
    out = []
    for fold in ("s1", "s2"):
        by = {}
        for f, q, d in run:
            if f == fold:
                by.setdefault(q, ([], []))[(q, d) not in good].append(d)
        lists = [(q, *[sorted(x, key=lambda d: (md5(q, d), d)) for x in by[q]]) for q in sorted(by) if all(by[q])]
        for s in range(end):
            h = md5(fold, s)
            u = [int(h[8 * i:8 * i + 8], 16) for i in range(3)]
            q, pos, neg = lists[u[0] % len(lists)]
            out.append((fold, s, q, pos[u[1] % len(pos)], neg[u[2] % len(neg)]))
    return sorted(out)


def test_stream_equals_brute_force_and_any_range_is_the_same(spark):
    run, qrels, run_df, qrels_df = make(spark)
    source = S.sample_source(run_df, qrels_df)
    want = brute_stream(run, qrels, 300)
    assert sorted(map(tuple, S.sample_stream(spark, source, 0, 300).collect())) == want
    part = sorted(map(tuple, S.sample_stream(spark, source, 120, 131).collect()))
    assert part == [w for w in want if 120 <= w[1] < 131]
    assert S.sample_stream(spark, source, 5, 5).count() == 0
    assert len({w[2] for w in want}) == 8  # queries without positives or negatives take no part
    none = S.sample_source(run_df, qrels_df.limit(0))
    assert S.sample_stream(spark, none, 0, 10).count() == 0


def test_training_equals_numpy_and_its_dev_log_is_the_metric_of_reranked_runs(spark):
    run, qrels, run_df, qrels_df = make(spark)
    rng = np.random.default_rng(1)
    feats = {(q, d): rng.random(2) + [0.8 * ((q, d, 1) in set(qrels)), 0] for _, q, d in run}
    feats_df = spark.createDataFrame([(q, d, float(v[0]), float(v[1])) for (q, d), v in feats.items()], "qid string, docid string, a double, b double")
    samples = S.sample_stream(spark, S.sample_source(run_df, qrels_df), 0, 5 * 40)
    diffs = TR.sample_differences(samples, feats_df, ["a", "b"], 40)
    weights, losses = TR.train_epochs(diffs, ["a", "b"], 5, start={"b": 0.5})
    got = {(r.fold, r.epoch, r.feature): r.weight for r in weights.collect()}
    lost = {(r.fold, r.epoch): (r.loss, r.n_samples) for r in losses.collect()}
    stream = brute_stream(run, qrels, 200)
    for fold in ("s1", "s2"):
        w = np.array([0.0, 0.5])
        for e in range(1, 6):
            d = np.array([feats[q, p] - feats[q, n] for f, s, q, p, n in stream if f == fold and s // 40 + 1 == e])
            margin = d @ w
            assert lost[fold, e][1] == 40 and abs(lost[fold, e][0] - np.maximum(0, 1 - margin).mean()) < 1e-7
            step = TR.RATE / e ** 0.5
            w = w * (1 - step * TR.REG) + step * d[margin < 1].sum(0) / len(d)
            assert np.allclose([got[fold, e, "a"], got[fold, e, "b"]], w, atol=1e-7)
    dev = feats_df.join(run_df, ["qid", "docid"])
    log = TR.dev_log(weights, dev, qrels_df, ["a", "b"], freq=2)
    values = {(r.run_id, r.epoch, r.metric): r.value for r in log.collect()}
    assert {k[1] for k in values} == {2, 4} and {k[2] for k in values} == set(TR.DEV_METRICS)
    # P@5 of one epoch by hand
    per = []
    for q in sorted({q for f, q, _ in run if f == "s1"}):
        if not any(x[0] == q for x in qrels):
            continue
        docs = [d for f, qq, d in run if f == "s1" and qq == q]
        score = lambda d: round(float(got["s1", 4, "a"] * feats[q, d][0] + got["s1", 4, "b"] * feats[q, d][1]), 6)
        first = sorted(docs, key=lambda d: (score(d), d), reverse=True)[:5]
        per.append(sum((q, d, 1) in set(qrels) for d in first) / 5)
    assert abs(values["s1", 4, "P_5"] - sum(per) / len(per)) < 1e-9
    best = {r.run_id: (r.epoch, r.value) for r in G.best_epoch(log, "map", 2).collect()}
    for fold, (epoch, value) in best.items():
        mine = {e: v for (f, e, m), v in values.items() if f == fold and m == "map"}
        assert value == max(mine.values()) and epoch == min(e for e, v in mine.items() if round(v, 9) == round(value, 9))
    assert {r.metric for r in G.select_metrics(log).collect()} == {f"dev-{m}" for m in G.DEFAULT_METRICS}


def test_a_sample_without_features_is_an_error(spark):
    samples = spark.createDataFrame([("s1", 0, "q", "a", "b")], "fold string, sample long, qid string, pos_docid string, neg_docid string")
    feats = spark.createDataFrame([("q", "a", 1.0)], "qid string, docid string, x double")
    with pytest.raises(Exception, match="no features for sample s1 0"):
        TR.sample_differences(samples, feats, ["x"]).collect()
