"""Training a linear ranker by epochs (K9) with a dev log of real metrics.

The model of a fold is one weight per feature.  An epoch takes its own range of the fold's
sample stream and makes one step against the sub-gradient of the pairwise hinge loss

    mean over samples of max(0, 1 - w . (f(pos) - f(neg)))  +  reg / 2 * |w|^2

for all folds in one aggregate: samples stay on the executors, folds x features sums come
back.  Weights are rounded to 9 digits after every step, so that a rerun agrees whatever
the order of summation.  The weights of all epochs are a table (fold, epoch, feature,
weight); every validated epoch reranks the dev queries and is judged by the evaluation
metrics, in one pass over the dev features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import metrics as E
from .retrieve import rank_within
from .samples import BATCH
from .sizing import broadcast_bounded, row_bound
from .trainlog import ITERSIZE, NITERS, VALIDATE_FREQ, validation_epochs

RATE = 1.0
REG = 0.001
DIGITS = 9
DEV_METRICS = (*E.DEFAULT_METRICS, "P_5", "ndcg_cut_5")


def scaled_features(features: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Each feature divided by its greatest value in the query (0 if that is not positive)."""
    top = features.groupBy("qid").agg(*[F.max(c).alias(f"_m_{c}") for c in feature_cols])
    return features.join(top, "qid").select("qid", "docid", *[
        F.when(F.col(f"_m_{c}") > 0, F.col(c) / F.col(f"_m_{c}")).otherwise(0.0).alias(c) for c in feature_cols])


def sample_differences(samples: DataFrame, features: DataFrame, feature_cols: Sequence[str],
                       per_epoch: int = ITERSIZE * BATCH) -> DataFrame:
    """(fold, epoch, sample, d_<f>..): feature differences of every sample, epochs from 1.

    A sample without features of either side is an error."""
    def side(name: str) -> DataFrame:
        return features.select("qid", F.col("docid").alias(f"{name}_docid"), F.lit(True).alias(f"_{name}"),
                               *[F.col(c).alias(f"{name}_{c}") for c in feature_cols])

    t = samples.join(side("pos"), ["qid", "pos_docid"], "left").join(side("neg"), ["qid", "neg_docid"], "left")
    known = F.coalesce(F.col("_pos") & F.col("_neg"), F.lit(False))
    lost = F.raise_error(F.concat_ws(" ", F.lit("no features for sample"), "fold", "sample")).cast("double")
    return t.select("fold", (F.floor(F.col("sample") / per_epoch) + 1).cast("int").alias("epoch"), "sample",
                    *[F.when(known, F.col(f"pos_{c}") - F.col(f"neg_{c}")).otherwise(lost).alias(f"d_{c}") for c in feature_cols])


def train_epochs(differences: DataFrame, feature_cols: Sequence[str], epochs: int = NITERS, rate: float = RATE,
                 reg: float = REG, start: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, losses): (fold, epoch, feature, weight) after each epoch, and (fold, epoch,
    loss, n_samples), the mean hinge loss that the epoch met.

    Step e moves by rate / sqrt(e).  The differences are written once in folders of their
    epoch, so an epoch reads its own samples only."""
    spark = differences.sparkSession
    path = scratch_dir(spark, "samples")
    differences.write.partitionBy("epoch").parquet(path)
    data = spark.read.parquet(path)
    folds = sorted(r.fold for r in data.select("fold").distinct().collect())
    w = {f: [float((start or {}).get(c, 0.0)) for c in feature_cols] for f in folds}
    weights, losses = [], []
    names = [f"w_{c}" for c in feature_cols]
    margin: Column = sum((F.col(n) * F.col(f"d_{c}") for n, c in zip(names, feature_cols)), F.lit(0.0))
    active = margin < 1
    sums = [F.sum(F.when(active, F.col(f"d_{c}")).otherwise(0.0)).alias(c) for c in feature_cols]
    for e in range(1, epochs + 1):
        now = spark.createDataFrame([(f, *w[f]) for f in folds], ", ".join(["fold string", *[f"{n} double" for n in names]]))
        got = (data.filter(F.col("epoch") == e).join(F.broadcast(now), "fold").groupBy("fold")
               .agg(F.count(F.lit(1)).alias("_n"), F.avg(F.greatest(F.lit(0.0), 1 - margin)).alias("_loss"), *sums).collect())
        for r in got:
            step = rate / e ** 0.5
            w[r.fold] = [round(x * (1 - step * reg) + step * r[c] / r["_n"], DIGITS) for x, c in zip(w[r.fold], feature_cols)]
            losses.append((r.fold, e, float(r["_loss"]), r["_n"]))
        weights += [(f, e, c, x) for f in folds for c, x in zip(feature_cols, w[f])]
    return (spark.createDataFrame(weights, "fold string, epoch int, feature string, weight double"),
            spark.createDataFrame(losses, "fold string, epoch int, loss double, n_samples long"))


def dev_log(weights: DataFrame, dev: DataFrame, qrels: DataFrame, feature_cols: Sequence[str], freq: int = VALIDATE_FREQ,
            metrics: Sequence[str] = DEV_METRICS, q_bound: int | None = None) -> DataFrame:
    """(run_id, epoch, metric, value): means of the dev queries, reranked with the weights of
    every ``freq``-th epoch.

    ``dev``: (fold, qid, docid, <f>..) of each fold's dev queries.  All epochs are scored in
    one pass: an epoch's scores are a row's columns times the broadcast weights."""
    wide = (validation_epochs(weights, freq).groupBy("fold", "epoch").pivot("feature", list(feature_cols)).agg(F.first("weight"))
            .select("fold", "epoch", *[F.col(c).alias(f"w_{c}") for c in feature_cols]))
    score: Column = sum((F.col(f"w_{c}") * F.col(c) for c in feature_cols), F.lit(0.0))
    scored = dev.join(broadcast_bounded(wide, row_bound(wide)), "fold").select("fold", "epoch", "qid", "docid", score.alias("score"))
    ranked = rank_within(scored, ["fold", "epoch", "qid"], "score")
    m = E.mean_metrics(E.eval_run(ranked, qrels, metrics, 1, ["fold", "epoch"], q_bound), ["fold", "epoch"])
    return m.select(F.col("fold").alias("run_id"), "epoch", "metric", "value")
