import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rankfold.operators import pairwise as P

REG = 0.01


def fold_objective(X, Y, sd, w_raw):
    """Per-fold RankSVM objective in the standardised space (what a separate fit minimises)."""
    ws = w_raw * sd
    margin = (X / sd) @ ws
    return np.mean(np.maximum(0.0, 1.0 - (2 * Y - 1) * margin)) + 0.5 * REG * np.sum(ws ** 2)


def test_joint_fit_reaches_each_folds_optimum(spark):
    rng = np.random.default_rng(7)
    rows = []
    for fold, w_true in (("s1", [2.0, -1.0]), ("s2", [0.5, 3.0])):
        for _ in range(200 if fold == "s1" else 120):
            x = rng.normal(size=2) * [1.0, 4.0]
            y = 1.0 if np.dot(w_true, x) + rng.normal() * 0.3 > 0 else 0.0
            rows.append((fold, y, float(x[0]), float(x[1])))
    ex = spark.createDataFrame(rows, "fold string, label double, d_a double, d_b double")
    joint = {(r.fold, r.feature): r.weight
             for r in P.fit_pairwise(ex, ["a", "b"], reg=REG, max_iter=300, tol=1e-9).collect()}
    for fold in ("s1", "s2"):
        X = np.array([[r[2], r[3]] for r in rows if r[0] == fold])
        Y = np.array([r[1] for r in rows if r[0] == fold])
        sd = X.std(axis=0, ddof=1)
        part = ex.filter(F.col("fold") == fold).select(
            "label", (F.col("d_a") / float(sd[0])).alias("a"), (F.col("d_b") / float(sd[1])).alias("b"))
        data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(part)
        m = LinearSVC(fitIntercept=False, regParam=REG, maxIter=300, tol=1e-9, standardization=False).fit(data)
        sep = fold_objective(X, Y, sd, m.coefficients.toArray() / sd)
        got = fold_objective(X, Y, sd, np.array([joint[(fold, "a")], joint[(fold, "b")]]))
        assert got <= sep * (1 + 1e-3)
        # the learned direction ranks like the true one
        assert np.sign(joint[(fold, "a")]) == np.sign({"s1": 2.0, "s2": 0.5}[fold])


def test_a_triplet_without_features_is_an_error(spark):
    trip = spark.createDataFrame([("1", "a", "b"), ("1", "a", "c")], "qid string, pos_docid string, neg_docid string")
    feats = spark.createDataFrame([("1", "a", 3.0), ("1", "b", 1.0)], "qid string, docid string, f double")
    got = P.pair_examples(trip.limit(1), feats, ["f"]).collect()
    assert sorted(tuple(r) for r in got) == [(0.0, -2.0), (1.0, 2.0)]
    with pytest.raises(Exception, match="no features for triplet 1 a c"):
        P.pair_examples(trip, feats, ["f"]).collect()


def test_pairwise_examples_hold_every_triplet(spark):
    from rankfold.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    per_fold = {r.fold: r["count"] for r in QUERIES["triplets"](spark, sf).groupBy("fold").count().collect()}
    got = {(r.fold, r.label): r["count"]
           for r in QUERIES["pairwise_examples"](spark, sf).groupBy("fold", "label").count().collect()}
    assert got == {(f, label): n for f, n in per_fold.items() for label in (0.0, 1.0)}
