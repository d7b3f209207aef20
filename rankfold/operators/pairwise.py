"""Pairwise hinge model (K9): a linear ranker fit on triplet feature differences.

The reference trains a neural reranker with a pairwise hinge loss
max(0, 1 - (s_pos - s_neg)).  Re-aimed as RankSVM: for every (query, pos, neg)
triplet the difference f(pos) - f(neg) is a positive example and its negation a
negative one; ``pyspark.ml`` ``LinearSVC`` (hinge loss, no intercept) fits the
weights on the executors.  One model per fold, trained on that fold's train
split only, so no test query leaks into its own model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import broadcast_bounded, row_bound


def pair_examples(triplets: DataFrame, features: DataFrame, feature_cols: Sequence[str],
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """(g.., label, d_<f>...) rows: +diff with label 1 and -diff with label 0.

    Every triplet gives its two rows; one without features of either side is an error."""
    g = list(group_cols)
    fp = features.select("qid", F.col("docid").alias("pos_docid"), F.lit(True).alias("_p"),
                         *[F.col(c).alias(f"p_{c}") for c in feature_cols])
    fn = features.select("qid", F.col("docid").alias("neg_docid"), F.lit(True).alias("_n"),
                         *[F.col(c).alias(f"n_{c}") for c in feature_cols])
    t = triplets.join(fp, ["qid", "pos_docid"], "left").join(fn, ["qid", "neg_docid"], "left")
    diffs = [(F.col(f"p_{c}") - F.col(f"n_{c}")) for c in feature_cols]
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), *[d.alias(f"d_{c}") for d, c in zip(diffs, feature_cols)]),
        F.struct(F.lit(0.0).alias("label"), *[(-d).alias(f"d_{c}") for d, c in zip(diffs, feature_cols)]),
    )
    lost = F.raise_error(F.concat_ws(" ", F.lit("no features for triplet"), "qid", "pos_docid", "neg_docid"))
    whole = F.when(F.col("_p") & F.col("_n"), both).otherwise(lost)
    # (explode would infer a filter on the array, which turns the left joins into inner ones)
    return t.select(*g, F.explode_outer(whole).alias("e")).select(*g, "e.*")


def fit_pairwise(examples: DataFrame, feature_cols: Sequence[str], reg: float = 0.01,
                 max_iter: int = 100, fold_col: str = "fold", tol: float = 1e-6) -> DataFrame:
    """Fit one linear hinge model per fold in a single ``LinearSVC`` job.

    Each example's (per-fold standardised) difference vector is placed in its
    fold's block of a (folds x features) vector; examples weigh 1/N_fold and the
    regularisation is divided by the number of folds.  The joint objective is
    then (1/F) * sum over folds of the per-fold RankSVM objective, whose blocks
    do not interact, so the joint minimum is every fold's own minimum while the
    data is scanned once per iteration for all folds.

    Returns (fold, feature, weight) in the original feature scale.
    """
    folds = [r[0] for r in examples.select(fold_col).distinct().orderBy(fold_col).collect()]
    d = len(feature_cols)
    stats = examples.groupBy(fold_col).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.stddev(f"d_{c}").alias(f"_sd_{c}") for c in feature_cols])
    ex = examples.join(broadcast_bounded(stats, len(folds)), fold_col)
    scaled = [F.when(F.col(f"_sd_{c}") > 0, F.col(f"d_{c}") / F.col(f"_sd_{c}")).otherwise(F.lit(0.0))
              for c in feature_cols]
    block_cols = []
    for k, f in enumerate(folds):
        for j, c in enumerate(feature_cols):
            name = f"_b{k}_{j}"
            ex = ex.withColumn(name, F.when(F.col(fold_col) == f, scaled[j]).otherwise(F.lit(0.0)))
            block_cols.append(name)
    ex = ex.withColumn("_w", F.lit(1.0) / F.col("_n"))
    data = VectorAssembler(inputCols=block_cols, outputCol="features").transform(ex).select("label", "features", "_w")
    model = LinearSVC(fitIntercept=False, regParam=reg / len(folds), maxIter=max_iter, tol=tol,
                      standardization=False, weightCol="_w").fit(data)
    coef = model.coefficients.toArray()
    sd = {r[fold_col]: r for r in stats.collect()}  # folds x features numbers
    rows = []
    for k, f in enumerate(folds):
        for j, c in enumerate(feature_cols):
            s = sd[f][f"_sd_{c}"]
            rows.append((f, c, float(coef[k * d + j] / s) if s else 0.0))
    return examples.sparkSession.createDataFrame(rows, f"{fold_col} string, feature string, weight double")


def score_linear(features: DataFrame, weights: DataFrame, feature_cols: Sequence[str],
                 key_cols: Sequence[str] = ("fold",)) -> DataFrame:
    """``linear`` scorer: score = w . f with the weights of the row's fold.

    ``weights`` = (fold, feature, weight) is tiny (folds x features) and is
    pivoted and broadcast onto the feature rows.
    """
    wide = weights.groupBy(*key_cols).pivot("feature", list(feature_cols)).agg(F.first("weight"))
    wide = wide.select(*key_cols, *[F.col(c).alias(f"w_{c}") for c in feature_cols])
    s: Column = F.lit(0.0)
    for c in feature_cols:
        s = s + F.col(f"w_{c}") * F.col(c)
    return features.join(broadcast_bounded(wide, row_bound(wide)), list(key_cols)).withColumn("score", s)
