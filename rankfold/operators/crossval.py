"""Cross-validation and run combination.

One plan covers every fold: the ``fold`` column replaces the per-fold loop.
Scores that do not depend on the fold are computed once and only then tagged
with folds (each query is dev in one fold and test in one fold, so tagging the
dev and test splits does not multiply rows).  Choices made on dev (best weight)
are small per-fold tables joined back by broadcast, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from . import metrics as E
from .benchmark import fold_number, split_run
from .labels import labels_of
from .retrieve import rank_within
from .sizing import broadcast_bounded

# Interpolation weights w in 0, .1, ..., 1 (fused = w * searcher + (1 - w) * reranker).
WEIGHTS = tuple(round(i / 10, 1) for i in range(11))


def assemble_runs(run: DataFrame, folds: DataFrame, splits: Sequence[str] = ("dev", "test"),
                  folds_bound: int | None = None) -> DataFrame:
    """The same (fold-independent) run serves as every fold's dev and test run."""
    return split_run(run, folds, folds_bound, splits)


def fold_metrics(runs: DataFrame, folds: DataFrame, sampled_qrels: DataFrame, full_qrels: DataFrame,
                 metrics: Sequence[str] = E.DEFAULT_METRICS, level: int = 1,
                 dev_qrels: str = "sampled", group_cols: Sequence[str] = (),
                 folds_bound: int | None = None, q_bound: int | None = None,
                 full_levels: DataFrame | None = None) -> DataFrame:
    """Mean metrics per (g.., fold, split) for dev and test.

    Dev is judged by the sampled qrels (``dev_qrels='full'`` for the inference
    path), test always by the full qrels.  ``runs`` with a ``fold`` column are
    per-fold runs; otherwise the run is shared by all folds.  ``full_levels``: the
    ``judged_levels`` of the full qrels, if they are counted already.
    """
    g = list(group_cols)
    if "fold" in runs.columns:
        f = folds.filter(F.col("split").isin("dev", "test")).select("fold", "split", "qid").distinct()
        tagged = runs.join(broadcast_bounded(f, folds_bound), ["fold", "qid"])
    else:
        tagged = assemble_runs(runs, folds, folds_bound=folds_bound)
    keys = [*g, "fold", "split"]
    if dev_qrels == "full":  # one set judges both splits: it is read and counted once
        both = tagged.filter(F.col("split").isin("dev", "test"))
        return E.mean_metrics(E.eval_run(both, full_qrels, metrics, level, keys, q_bound, full_levels), keys)
    dev = E.eval_run(tagged.filter(F.col("split") == "dev"),
                     sampled_qrels, metrics, level, keys, q_bound)
    test = E.eval_run(tagged.filter(F.col("split") == "test"), full_qrels, metrics, level, keys, q_bound, full_levels)
    return E.mean_metrics(dev.unionByName(test), keys)


def cv_ready(runs: DataFrame, folds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The rows of every run (``group_cols``) that has all folds of ``folds``; a run
    that lacks one gives no rows.

    The folds needed are a scalar subquery; the gate is one row per run, broadcast
    behind its count only if the caller's groups are small enough for Spark to choose so.
    """
    g = list(group_cols)
    need = folds.select(F.count_distinct("fold")).scalar()
    if not g:
        return runs.filter(runs.select(F.count_distinct("fold")).scalar() == need)
    whole = runs.groupBy(*g).agg(F.count_distinct("fold").alias("_have")).filter(F.col("_have") == need)
    return runs.join(whole.select(*g), g, "left_semi")


def restrict_to_test(runs: DataFrame, folds: DataFrame, folds_bound: int | None = None) -> DataFrame:
    """Keep only rows whose query is in its own fold's test set."""
    t = folds.filter(F.col("split") == "test").select("fold", "qid").distinct()
    return runs.join(broadcast_bounded(t, folds_bound), ["fold", "qid"], "left_semi")


def union_test(runs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One run from all folds' test predictions; for a (qid, docid) in several
    folds the later fold wins.  A grouped ``max_by`` (partial aggregation), then
    new ranks per query."""
    g = list(group_cols)
    u = (runs.groupBy(*g, "qid", "docid")
         .agg(F.max_by("score", fold_number("fold")).alias("score")))
    return rank_within(u, [*g, "qid"], "score")


def cv_metrics(runs: DataFrame, folds: DataFrame, full_qrels: DataFrame,
               metrics: Sequence[str] = E.DEFAULT_METRICS, level: int = 1,
               group_cols: Sequence[str] = (), folds_bound: int | None = None,
               q_bound: int | None = None) -> DataFrame:
    """Cross-validated means over the union of own-test predictions (full qrels).

    ``runs`` = (g.., fold, split, qid, docid, score) with per-fold test runs.  The gate
    (X2) comes first: a run without every fold has no cross-validated result.
    """
    runs = cv_ready(runs, folds, group_cols)
    t = restrict_to_test(runs.filter(F.col("split") == "test"), folds, folds_bound)
    u = union_test(t, group_cols)
    return E.mean_metrics(E.eval_run(u, full_qrels, metrics, level, group_cols, q_bound), group_cols)


def minmax(df: DataFrame, keys: Sequence[str], col: str, out: str,
           keys_bound: int | None = None) -> DataFrame:
    """Per-group min-max normalisation; a constant group maps to 0.

    The (min, max) per group is a grouped aggregate broadcast back behind
    ``keys_bound`` (e.g. the number of topics), so the run is not shuffled.
    """
    mm = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return (df.join(broadcast_bounded(mm, keys_bound), list(keys))
            .withColumn(out, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(0.0)))
            .drop("_lo", "_hi"))


def interpolate(search: DataFrame, rerank: DataFrame, folds: DataFrame, sampled_qrels: DataFrame,
                full_qrels: DataFrame, optimize: str = "ndcg_cut_20",
                metrics: Sequence[str] = E.DEFAULT_METRICS, weights: Sequence[float] = WEIGHTS,
                level: int = 1, folds_bound: int | None = None, q_bound: int | None = None,
                pooled: bool = False) -> DataFrame:
    """Searcher (+) reranker fusion with the weight chosen per fold on dev.

    Inputs are (qid, docid, score) runs shared by all folds, so the per
    (fold, split, qid) min-max normalisation equals a per-query one and is done
    once, before the fold tags.  A document missing on one side gets 0 there.
    Labels (sampled and full) are joined once, before the weights multiply the
    dev rows; every weight is evaluated on dev only, with ranks and metrics from
    one window and one aggregate.  The best weight per fold (ties: smaller w) is
    a small table broadcast back onto the test rows, fused once.  Output:
    (fold, weight, dev_value, metric, value) with the chosen weight's test means; with
    ``pooled`` the cross-validated result instead: (metric, value, n_queries), means over
    the test queries of all folds, each fused with its fold's weight.
    """
    s = minmax(search.select("qid", "docid", "score"), ["qid"], "score", "s_norm", q_bound).drop("score")
    r = minmax(rerank.select("qid", "docid", "score"), ["qid"], "score", "r_norm", q_bound).drop("score")
    both = (s.join(r, ["qid", "docid"], "full")
            .select("qid", "docid", F.coalesce("s_norm", F.lit(0.0)).alias("s_norm"),
                    F.coalesce("r_norm", F.lit(0.0)).alias("r_norm")))
    both = checkpoint(both)
    labelled = (both.join(labels_of(both, sampled_qrels.select("qid", "docid", F.col("rel").alias("rel_dev"))), ["qid", "docid"], "left")
                .join(labels_of(both, full_qrels.select("qid", "docid", F.col("rel").alias("rel_test"))), ["qid", "docid"], "left"))
    labelled = checkpoint(labelled)
    tagged = assemble_runs(labelled, folds, folds_bound=folds_bound)
    fused = F.col("weight") * F.col("s_norm") + (F.lit(1.0) - F.col("weight")) * F.col("r_norm")
    wlist = F.array(*[F.lit(float(w)) for w in weights])
    dev = (tagged.filter(F.col("split") == "dev")
           .select("fold", "qid", "docid", "s_norm", "r_norm", F.col("rel_dev").alias("rel"), F.explode(wlist).alias("weight"))
           .withColumn("score", fused))
    dev_pq = E.per_query_scored(dev, None, [optimize], level, ["fold", "weight"],
                                consts=E.query_constants(sampled_qrels, _ndcg_ks([optimize]), level),
                                q_bound=q_bound)
    dev_means = E.mean_metrics(E.to_long(dev_pq, ["fold", "weight", "qid"], [optimize]), ["fold", "weight"])
    wbest = Window.partitionBy("fold").orderBy(F.round("value", 9).desc(), F.col("weight").asc())
    chosen = (dev_means.withColumn("_r", F.row_number().over(wbest)).filter("_r = 1")
              .select("fold", "weight", F.col("value").alias("dev_value")))
    test = (tagged.filter(F.col("split") == "test")
            .join(broadcast_bounded(chosen, folds_bound), "fold")
            .select("fold", "weight", "dev_value", "qid", "docid", F.col("rel_test").alias("rel"),
                    fused.alias("score")))
    test_pq = E.per_query_scored(test, None, metrics, level, ["fold", "weight", "dev_value"],
                                 consts=E.query_constants(full_qrels, _ndcg_ks(metrics), level), q_bound=q_bound)
    if pooled:
        return E.mean_metrics(E.to_long(test_pq, ["fold", "weight", "dev_value", "qid"], metrics))
    tm = E.mean_metrics(E.to_long(test_pq, ["fold", "weight", "dev_value", "qid"], metrics),
                        ["fold", "weight", "dev_value"])
    return tm.select("fold", "weight", "dev_value", "metric", "value")


def _ndcg_ks(metrics: Sequence[str]) -> list[int]:
    return sorted({k for _, kind, k in E._parse(metrics) if kind == "ndcg_cut"})


def experiment_matrix(means: DataFrame, dims: Sequence[str], metrics: Sequence[str] = E.DEFAULT_METRICS,
                      subtotals: bool = False) -> DataFrame:
    """One row per experiment cell with a column per metric (pivot).

    ``means`` = (dims.., metric, value).  With ``subtotals`` the cells are also
    rolled up along ``dims`` from right to left (mean of the cell means); the
    ``level`` column is the grouping id (0 = a full cell).
    """
    if not subtotals:
        return means.groupBy(*dims).pivot("metric", list(metrics)).agg(F.avg("value"))
    r = (means.rollup("metric", *dims)
         .agg(F.avg("value").alias("value"), F.grouping_id().alias("level"))
         .filter(F.col("metric").isNotNull()))
    return r.groupBy(*dims, "level").pivot("metric", list(metrics)).agg(F.first("value"))
