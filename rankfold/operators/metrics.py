"""Ranking metrics (E1-E7): P@k, AP, nDCG@k, bpref, judged@k, all in one plan.

For a run with ranks (``per_query``) every metric only needs the *judged*
retrieved rows, so the run is inner-joined with the qrels first and all windows
run over judged rows of one query (bounded by that query's judgments, never by
the run length).  For a run given by scores (``per_query_scored``) ranks and
running counts come from one window over the query's rows of a top-k run and
every metric from one aggregate.  The ideal DCG comes from the number of judgments
of each level alone.  Runs are written once, so that their pairs can be counted
and broadcast onto the qrels (``labels_of``).  The query set of a
mean is the queries present in both the run and the qrels; a query with no
relevant document scores 0.

Definitions (published):
  AP      = 1/R * sum over relevant retrieved d of (#relevant ranked <= rank(d)) / rank(d)
  P@k     = #relevant in top k / k            (k also when fewer retrieved)
  nDCG@k  = sum_{rank<=k} rel/log2(rank+1) / ideal; 0 when ideal is 0
  bpref   = 1/R * sum over relevant retrieved d of 1 - min(n_above(d), m)/m,
            m = min(R, N), N judged non-relevant; 1 per relevant when N = 0
  judged@k = #judged in top k / k
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .labels import labels_of
from .sizing import broadcast_bounded

# The metric names kept by the reference's validation log.
DEFAULT_METRICS = ("map", "bpref", "P_20", "ndcg_cut_20", "judged_10", "judged_20", "judged_200")


def _log2(c: Column) -> Column:
    return F.log(c) / F.log(F.lit(2.0))


def _parse(metrics: Sequence[str]) -> list[tuple[str, str, int | None]]:
    out = []
    for m in metrics:
        if m in ("map", "bpref"):
            out.append((m, m, None))
            continue
        mm = re.fullmatch(r"(P|ndcg_cut|judged)_(\d+)", m)
        if not mm:
            raise ValueError(f"unknown metric {m!r}")
        out.append((m, mm.group(1), int(mm.group(2))))
    return out


def binarize(qrels: DataFrame, level: int = 1) -> DataFrame:
    """Relevant iff rel >= level."""
    return qrels.withColumn("relevant", F.col("rel") >= F.lit(level))


def judge(run: DataFrame, qrels: DataFrame, level: int = 1,
          group_cols: Sequence[str] = (), q_bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged retrieved rows with per-query constants, query set).

    Returns ``judged`` = (g.., qid, docid, rank, rel, R, N) and ``qset`` =
    (g.., qid, R, N) for the queries present in both inputs.  The per-query
    constants are broadcast behind ``q_bound`` (the number of topics).
    """
    return _judge(run, qrels, judged_levels(qrels), level, group_cols, q_bound)


def _judge(run: DataFrame, qrels: DataFrame, levels: DataFrame, level: int, group_cols: Sequence[str],
           q_bound: int | None, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    g = list(group_cols)
    q = qrels.select("qid", "docid", "rel")
    run = checkpoint(run.select(*g, "qid", "docid", "rank"))
    qstats = broadcast_bounded(_relevant(levels, level), q_bound)
    qset = run.select(*g, "qid").distinct().join(qstats, "qid")
    seen = run if depth is None else run.filter(F.col("rank") <= depth)
    judged = seen.join(labels_of(seen, q), ["qid", "docid"]).join(qstats, "qid")
    return judged, qset


def judged_levels(qrels: DataFrame) -> DataFrame:
    """(qid, rel, n): judgments of every query and level, written: all that R, N and the ideal
    DCG need of them, so the judgments are neither shuffled nor sorted for these."""
    return checkpoint(qrels.groupBy("qid", "rel").agg(F.count(F.lit(1)).alias("n")))


def _relevant(levels: DataFrame, level: int) -> DataFrame:
    return levels.groupBy("qid").agg(
        F.sum(F.when(F.col("rel") >= level, F.col("n")).otherwise(0)).alias("R"),
        F.sum(F.when(F.col("rel") < level, F.col("n")).otherwise(0)).alias("N"))


def ideal_dcg(qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(qid, idcg_<k>...) from all judged documents of a query, best levels first."""
    if not ks:
        return qrels.select("qid").distinct()
    return _ideal(judged_levels(qrels), ks)


def _ideal(levels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The places 1..k of the best ranking, from the number of documents of each level."""
    kmax = max(ks)
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc())
    top = (levels.filter(F.col("rel") > 0).withColumn("_to", F.sum("n").over(w))
           .withColumn("_from", F.col("_to") - F.col("n") + 1).filter(F.col("_from") <= kmax)
           .select("qid", "rel", F.explode(F.sequence("_from", F.least("_to", F.lit(kmax)))).alias("_i")))
    gain = F.col("rel") / _log2(F.col("_i") + F.lit(1.0))
    return top.groupBy("qid").agg(*[
        F.sum(F.when(F.col("_i") <= k, gain).otherwise(0.0)).alias(f"idcg_{k}") for k in sorted(set(ks))])


def per_query(run: DataFrame, qrels: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS,
              level: int = 1, group_cols: Sequence[str] = (), q_bound: int | None = None,
              levels: DataFrame | None = None) -> DataFrame:
    """E1-E5 per query, wide: (g.., qid, <metric>...).  ``run`` needs qid, docid, rank.  With
    ``levels`` (``judged_levels`` of all judgments) ``qrels`` may be those of the run's documents."""
    g = list(group_cols)
    spec = _parse(metrics)
    if levels is None:
        levels = judged_levels(qrels)
    # cutoff metrics need no judgment beyond their greatest cutoff
    depth = max(k for *_, k in spec) if all(k for *_, k in spec) else None
    judged, qset = _judge(run, qrels, levels, level, g, q_bound, depth)
    w = Window.partitionBy(*g, "qid").orderBy("rank", "docid")
    is_rel = (F.col("rel") >= level).cast("int")
    j = (judged.withColumn("is_rel", is_rel)
         .withColumn("pos_j", F.row_number().over(w))
         .withColumn("pos_r", F.sum("is_rel").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rank = F.col("rank")
    m = F.least(F.col("R"), F.col("N"))
    aggs = []
    ndcg_ks = sorted({k for _, kind, k in spec if kind == "ndcg_cut"})
    for name, kind, k in spec:
        if kind == "map":
            aggs.append(F.sum(F.when(F.col("is_rel") == 1, F.col("pos_r") / rank).otherwise(0.0)).alias("_ap"))
        elif kind == "bpref":
            term = F.when(F.col("N") == 0, F.lit(1.0)).otherwise(
                F.lit(1.0) - F.least(F.col("pos_j") - F.col("pos_r"), m) / m)
            aggs.append(F.sum(F.when(F.col("is_rel") == 1, term).otherwise(0.0)).alias("_bpref"))
        elif kind == "P":
            aggs.append(F.sum(F.when((rank <= k) & (F.col("is_rel") == 1), 1).otherwise(0)).alias(f"_rel_{k}"))
        elif kind == "judged":
            aggs.append(F.sum(F.when(rank <= k, 1).otherwise(0)).alias(f"_jud_{k}"))
    for k in ndcg_ks:
        aggs.append(F.sum(F.when((rank <= k) & (F.col("rel") > 0),
                                 F.col("rel") / _log2(rank + F.lit(1.0))).otherwise(0.0)).alias(f"_dcg_{k}"))
    per = j.groupBy(*g, "qid").agg(*aggs)
    out = qset.join(per, [*g, "qid"], "left")
    if ndcg_ks:
        out = out.join(broadcast_bounded(_ideal(levels, ndcg_ks), q_bound),
                       "qid", "left")
    R = F.col("R")
    cols = []
    for name, kind, k in spec:
        if kind == "map":
            v = F.when(R > 0, F.coalesce(F.col("_ap"), F.lit(0.0)) / R).otherwise(0.0)
        elif kind == "bpref":
            v = F.when(R > 0, F.coalesce(F.col("_bpref"), F.lit(0.0)) / R).otherwise(0.0)
        elif kind == "P":
            v = F.coalesce(F.col(f"_rel_{k}"), F.lit(0)) / F.lit(float(k))
        elif kind == "judged":
            v = F.coalesce(F.col(f"_jud_{k}"), F.lit(0)) / F.lit(float(k))
        else:
            idcg = F.coalesce(F.col(f"idcg_{k}"), F.lit(0.0))
            v = F.when(idcg > 0, F.coalesce(F.col(f"_dcg_{k}"), F.lit(0.0)) / idcg).otherwise(0.0)
        cols.append(v.cast("double").alias(name))
    return out.select(*g, "qid", *cols)


def query_constants(qrels: DataFrame, ks_ndcg: Sequence[int] = (), level: int = 1) -> DataFrame:
    """(qid, R, N, idcg_<k>...): one small row per judged query."""
    levels = judged_levels(qrels)
    qstats = _relevant(levels, level)
    if not ks_ndcg:
        return qstats
    return qstats.join(_ideal(levels, ks_ndcg), "qid", "left")


def per_query_scored(scored: DataFrame, qrels: DataFrame | None, metrics: Sequence[str] = DEFAULT_METRICS,
                     level: int = 1, group_cols: Sequence[str] = (), score_col: str = "score",
                     consts: DataFrame | None = None, q_bound: int | None = None,
                     digits: int | None = 6) -> DataFrame:
    """K8 + E1-E5 in one window and one aggregate, for runs given by scores.

    ``scored`` = (g.., qid, docid, score[, rel]).  Ranks are assigned in the
    same window (score desc after rounding to ``digits``, then docid desc) that
    keeps the running counts of judged and relevant documents, and one grouped
    aggregate produces every metric.  Per-query constants (R, N, ideal DCG) are a
    small table broadcast behind ``q_bound`` (the number of topics).  Windows
    hold the rows of one query of one group, bounded by the run depth.
    """
    g = list(group_cols)
    spec = _parse(metrics)
    ks = sorted({k for _, kind, k in spec if kind == "ndcg_cut"})
    if consts is None:
        consts = query_constants(qrels, ks, level)
    df = scored
    if "rel" not in df.columns:
        df = df.join(labels_of(df, qrels.select("qid", "docid", "rel")), ["qid", "docid"], "left")
    df = df.join(broadcast_bounded(consts, q_bound), "qid")
    key = F.round(score_col, digits) if digits is not None else F.col(score_col)
    w = Window.partitionBy(*g, "qid").orderBy(key.desc(), F.col("docid").desc())
    run_w = w.rowsBetween(Window.unboundedPreceding, 0)
    is_rel = F.when(F.col("rel") >= level, 1).otherwise(0)
    if all(kind in ("P", "ndcg_cut", "judged") for _, kind, _ in spec):
        # Cutoff metrics only need ranks <= max k: row_number() <= k is planned as a
        # WindowGroupLimit, so each task keeps at most k rows per group before the shuffle.
        kmax = max(k for _, _, k in spec)
        df = (df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kmax)
              .withColumn("is_rel", is_rel))
    else:
        df = (df.withColumn("rank", F.row_number().over(w))
              .withColumn("pos_j", F.sum(F.when(F.col("rel").isNotNull(), 1).otherwise(0)).over(run_w))
              .withColumn("pos_r", F.sum(is_rel).over(run_w))
              .withColumn("is_rel", is_rel))
    rank, R, N = F.col("rank"), F.col("R"), F.col("N")
    m = F.least(R, N)
    aggs = [F.first("R").alias("_R")] + [F.first(f"idcg_{k}").alias(f"_idcg_{k}") for k in ks]
    judged = F.col("rel").isNotNull()
    for name, kind, k in spec:
        if kind == "map":
            aggs.append(F.sum(F.when(F.col("is_rel") == 1, F.col("pos_r") / rank).otherwise(0.0)).alias("_ap"))
        elif kind == "bpref":
            term = F.when(N == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.least(F.col("pos_j") - F.col("pos_r"), m) / m)
            aggs.append(F.sum(F.when(F.col("is_rel") == 1, term).otherwise(0.0)).alias("_bpref"))
        elif kind == "P":
            aggs.append(F.sum(F.when((rank <= k) & (F.col("is_rel") == 1), 1).otherwise(0)).alias(f"_rel_{k}"))
        elif kind == "judged":
            aggs.append(F.sum(F.when((rank <= k) & judged, 1).otherwise(0)).alias(f"_jud_{k}"))
    for k in ks:
        aggs.append(F.sum(F.when((rank <= k) & (F.col("rel") > 0),
                                 F.col("rel") / _log2(rank + F.lit(1.0))).otherwise(0.0)).alias(f"_dcg_{k}"))
    per = df.groupBy(*g, "qid").agg(*aggs)
    R = F.col("_R")
    cols = []
    for name, kind, k in spec:
        if kind == "map":
            v = F.when(R > 0, F.col("_ap") / R).otherwise(0.0)
        elif kind == "bpref":
            v = F.when(R > 0, F.col("_bpref") / R).otherwise(0.0)
        elif kind == "P":
            v = F.col(f"_rel_{k}") / F.lit(float(k))
        elif kind == "judged":
            v = F.col(f"_jud_{k}") / F.lit(float(k))
        else:
            idcg = F.coalesce(F.col(f"_idcg_{k}"), F.lit(0.0))
            v = F.when(idcg > 0, F.col(f"_dcg_{k}") / idcg).otherwise(0.0)
        cols.append(v.cast("double").alias(name))
    return per.select(*g, "qid", *cols)


def to_long(wide: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns -> (ids.., metric, value)."""
    return wide.unpivot(list(id_cols), list(metrics), "metric", "value")


def eval_run(run: DataFrame, qrels: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS,
             level: int = 1, group_cols: Sequence[str] = (), q_bound: int | None = None,
             levels: DataFrame | None = None) -> DataFrame:
    """Per-query metrics in long form (g.., qid, metric, value); ``levels`` as in ``per_query``."""
    wide = per_query(run, qrels, metrics, level, group_cols, q_bound, levels)
    return to_long(wide, [*group_cols, "qid"], metrics)


def mean_metrics(per_query_long: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean over the query set: (g.., metric, value, n_queries)."""
    return (per_query_long.groupBy(*group_cols, "metric")
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_queries")))
