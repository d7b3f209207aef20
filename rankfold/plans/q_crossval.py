"""Cross-validation and run-combination queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import crossval as CV
from ..operators import metrics as E
from ..operators.sizing import broadcast_bounded
from ..session import checkpoint
from . import oracle as O
from .q_bench import SAMPLE_RATE, SEED, grid_union_sql
from .q_rerank import all_reranked
from .registry import X, r6, register

METRIC_COLS = "map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200"


def _folds_bound(x) -> int:
    return x.n_topics * 5


def _test_runs(x):
    """Per-fold test runs of the MaxP reranker (fold, split, qid, docid, score, rank)."""
    return CV.assemble_runs(x.reranked("max"), x.folds(5), ("test",), _folds_bound(x))


O.cte("maxp_tagged", ("maxp", "folds5"), """
SELECT f.fold, f.split, m.qid, m.docid, m.score, m.rank FROM maxp m JOIN folds5 f ON m.qid = f.qid
WHERE f.split IN ('dev', 'test')
""")


def _means_sql(pq: str, keys: str) -> str:
    return f"""
SELECT {keys}, metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries FROM (
  UNPIVOT (SELECT * FROM {pq} pq) ON {METRIC_COLS} INTO NAME metric VALUE value)
GROUP BY {keys}, metric
"""


def _fold_metrics_sql() -> str:
    g = ("fold", "split")
    dev = O.per_query_sql("(SELECT * FROM maxp_tagged WHERE split = 'dev')", "shallow50", group=g)
    test = O.per_query_sql("(SELECT * FROM maxp_tagged WHERE split = 'test')", "qrels", group=g)
    return _means_sql(f"(SELECT * FROM {dev} d UNION ALL SELECT * FROM {test} t)", "fold, split")


@register("fold_metrics", O.sql(_fold_metrics_sql(), "maxp_tagged", "shallow50", "qrels"))
def q_fold_metrics(spark, sf_dir):
    """Dev (sampled qrels) and test (full qrels) means of MaxP in every fold."""
    x = X(spark, sf_dir)
    sampled = B.sample_shallow(x.qrels, SAMPLE_RATE, SEED)
    m = CV.fold_metrics(x.reranked("max"), x.folds(5), sampled, x.qrels, folds_bound=_folds_bound(x),
                        q_bound=x.n_topics)
    return m.select("fold", "split", "metric", r6("value").alias("value"), "n_queries")


def _fold_metrics_inference_sql() -> str:
    pq = O.per_query_sql("maxp_tagged", "qrels", group=("fold", "split"))
    return _means_sql(pq, "fold, split")


@register("fold_metrics_inference", O.sql(_fold_metrics_inference_sql(), "maxp_tagged", "qrels"))
def q_fold_metrics_inference(spark, sf_dir):
    """X1 on the inference path: dev is judged by the full qrels too."""
    x = X(spark, sf_dir)
    m = CV.fold_metrics(x.reranked("max"), x.folds(5), x.qrels, x.qrels, dev_qrels="full",
                        folds_bound=_folds_bound(x), q_bound=x.n_topics)
    return m.select("fold", "split", "metric", r6("value").alias("value"), "n_queries")


@register("cv_gate", O.sql("""
SELECT 'whole' AS run_id, fold, CAST(count(*) AS BIGINT) AS n_rows FROM maxp_tagged WHERE split = 'test' GROUP BY fold
""", "maxp_tagged"))
def q_cv_gate(spark, sf_dir):
    """X2 per run: of a run with all folds and one without s2, only the first passes."""
    x = X(spark, sf_dir)
    runs = _test_runs(x)
    # (a run id that is data, not a constant of a branch, keeps the gate's join an equi-join)
    both = runs.withColumn("run_id", F.explode(F.array(F.lit("whole"), F.lit("part")))).filter(
        (F.col("run_id") == "whole") | (F.col("fold") != "s2"))
    g = CV.cv_ready(both, x.folds(5), ["run_id"])
    return g.groupBy("run_id", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("cv_ready", O.sql("""
SELECT fold, CAST(count(*) AS BIGINT) AS n_rows FROM maxp_tagged
WHERE split = 'test' AND (SELECT count(DISTINCT fold) FROM maxp_tagged WHERE split = 'test')
                       = (SELECT count(DISTINCT fold) FROM folds5)
GROUP BY fold
""", "maxp_tagged", "folds5"))
def q_cv_ready(spark, sf_dir):
    """All five folds have test runs, so the gate lets every row through."""
    x = X(spark, sf_dir)
    g = CV.cv_ready(_test_runs(x), x.folds(5))
    return g.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("cv_not_ready", O.sql("""
SELECT fold, CAST(count(*) AS BIGINT) AS n_rows FROM maxp_tagged
WHERE split = 'test' AND fold <> 's2'
  AND (SELECT count(DISTINCT fold) FROM maxp_tagged WHERE split = 'test' AND fold <> 's2')
    = (SELECT count(DISTINCT fold) FROM folds5)
GROUP BY fold
""", "maxp_tagged", "folds5"))
def q_cv_not_ready(spark, sf_dir):
    """Fold s2 has no run, so the cross-validated result is empty."""
    x = X(spark, sf_dir)
    runs = _test_runs(x).filter(F.col("fold") != "s2")
    return CV.cv_ready(runs, x.folds(5)).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


O.cte("own_test", ("maxp_tagged", "folds5"), """
SELECT m.* FROM maxp_tagged m WHERE EXISTS (
  SELECT 1 FROM folds5 f WHERE f.split = 'test' AND f.fold = m.fold AND f.qid = m.qid)
""")


@register("own_test", O.sql("SELECT fold, split, qid, docid FROM own_test", "own_test"))
def q_own_test(spark, sf_dir):
    """Rows of the dev+test run set whose query is in the fold's own test set."""
    x = X(spark, sf_dir)
    runs = CV.assemble_runs(x.reranked("max"), x.folds(5), ("dev", "test"), _folds_bound(x))
    return CV.restrict_to_test(runs, x.folds(5), _folds_bound(x)).select("fold", "split", "qid", "docid")


O.cte("union_test", ("own_test",), """
SELECT qid, docid, score,
       CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, docid DESC) AS INTEGER) AS rank
FROM (SELECT qid, docid, max_by(score, CAST(substr(fold, 2) AS INTEGER)) AS score
      FROM own_test WHERE split = 'test' GROUP BY qid, docid)
""")


@register("union_test", O.sql("SELECT qid, docid, rank, round(score, 6) AS score FROM union_test", "union_test"))
def q_union_test(spark, sf_dir):
    """One run from every fold's own test predictions."""
    x = X(spark, sf_dir)
    t = CV.restrict_to_test(_test_runs(x), x.folds(5), _folds_bound(x))
    return CV.union_test(t).select("qid", "docid", "rank", r6("score").alias("score"))


@register("cv_metrics", O.sql(
    _means_sql(f"(SELECT 'cv' AS scope, * FROM {O.per_query_sql('union_test')} p)", "scope"),
    "union_test", "qrels"))
def q_cv_metrics(spark, sf_dir):
    """Cross-validated means over the union (full qrels)."""
    x = X(spark, sf_dir)
    m = CV.cv_metrics(_test_runs(x), x.folds(5), x.qrels, folds_bound=_folds_bound(x), q_bound=x.n_topics)
    return m.select(F.lit("cv").alias("scope"), "metric", r6("value").alias("value"), "n_queries")


@register("assemble_runs", O.sql("""
SELECT f.fold, f.split, r.qid, r.docid, r.rank, round(r.score, 6) AS score
FROM cut r JOIN folds5 f ON r.qid = f.qid WHERE f.split IN ('dev', 'test')
""", "cut", "folds5"))
def q_assemble_runs(spark, sf_dir):
    """The searcher's cut run serves as every fold's dev and test run."""
    x = X(spark, sf_dir, False)
    a = CV.assemble_runs(x.cut, x.folds(5), ("dev", "test"), _folds_bound(x))
    return a.select("fold", "split", "qid", "docid", "rank", r6("score").alias("score"))


# ------------------------------------------------------------------ X6 interpolation
def _interp_sql(pooled: bool = False) -> str:
    w_list = ", ".join(f"CAST({w} AS DOUBLE)" for w in CV.WEIGHTS)
    keys = "fold, split, qid"
    norm = lambda src, c: f"""
SELECT {keys}, docid,
       CASE WHEN max(score) OVER (PARTITION BY {keys}) > min(score) OVER (PARTITION BY {keys})
            THEN (score - min(score) OVER (PARTITION BY {keys}))
                 / (max(score) OVER (PARTITION BY {keys}) - min(score) OVER (PARTITION BY {keys}))
            ELSE CAST(0.0 AS DOUBLE) END AS {c}
FROM (SELECT f.fold, f.split, r.qid, r.docid, r.score FROM {src} r JOIN folds5 f ON r.qid = f.qid
      WHERE f.split IN ('dev', 'test'))"""
    dev_pq = O.per_query_sql("dev_ranked", "shallow50", ks_p=(), ks_judged=(), group=("fold", "weight"))
    test_pq = O.per_query_sql("test_ranked", "qrels", group=("fold", "weight", "dev_value"))
    if pooled:
        out, by = "metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries", "metric"
    else:
        out = "fold, weight, round(dev_value, 6) AS dev_value, metric, round(avg(value), 6) AS value"
        by = "fold, weight, dev_value, metric"
    return f"""
SELECT * FROM (
WITH s AS ({norm('run', 's')}),
r AS ({norm('maxp', 'r')}),
both_ AS (SELECT coalesce(s.fold, r.fold) AS fold, coalesce(s.split, r.split) AS split,
                 coalesce(s.qid, r.qid) AS qid, coalesce(s.docid, r.docid) AS docid,
                 coalesce(s.s, 0.0) AS s, coalesce(r.r, 0.0) AS r
          FROM s FULL OUTER JOIN r ON s.fold = r.fold AND s.split = r.split AND s.qid = r.qid AND s.docid = r.docid),
dev AS (SELECT fold, qid, docid, weight, weight * s + (CAST(1.0 AS DOUBLE) - weight) * r AS score
        FROM (SELECT *, unnest([{w_list}]) AS weight FROM both_ WHERE split = 'dev')),
dev_ranked AS (SELECT *, row_number() OVER (PARTITION BY fold, weight, qid ORDER BY round(score, 6) DESC, docid DESC) AS rank FROM dev),
dev_means AS (SELECT fold, weight, avg(ndcg_cut_20) AS value FROM {dev_pq} p GROUP BY fold, weight),
chosen AS (SELECT fold, weight, value AS dev_value FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(value, 9) DESC, weight ASC) AS rr FROM dev_means) WHERE rr = 1),
test AS (SELECT b.fold, b.qid, b.docid, c.weight, c.dev_value,
                c.weight * b.s + (CAST(1.0 AS DOUBLE) - c.weight) * b.r AS score
         FROM both_ b JOIN chosen c ON b.fold = c.fold WHERE b.split = 'test'),
test_ranked AS (SELECT *, row_number() OVER (PARTITION BY fold, qid ORDER BY round(score, 6) DESC, docid DESC) AS rank FROM test)
SELECT {out} FROM (
  UNPIVOT (SELECT * FROM {test_pq} p) ON {METRIC_COLS} INTO NAME metric VALUE value)
GROUP BY {by})
"""


@register("interpolate", O.sql(_interp_sql(), "run", "maxp", "folds5", "shallow50", "qrels"))
def q_interpolate(spark, sf_dir):
    """BM25 (+) MaxP fusion, weight picked per fold on dev (sampled qrels),
    test metrics of the chosen weight (full qrels)."""
    x = X(spark, sf_dir)
    sampled = B.sample_shallow(x.qrels, SAMPLE_RATE, SEED)
    out = CV.interpolate(x.search_run, x.reranked("max"), x.folds(5), sampled, x.qrels,
                         folds_bound=_folds_bound(x), q_bound=x.n_topics)
    return out.select("fold", "weight", r6("dev_value").alias("dev_value"), "metric", r6("value").alias("value"))


@register("interpolate_cv", O.sql(_interp_sql(pooled=True), "run", "maxp", "folds5", "shallow50", "qrels"))
def q_interpolate_cv(spark, sf_dir):
    """X6 cross-validated: every query fused with its own fold's weight, means over all."""
    x = X(spark, sf_dir)
    sampled = B.sample_shallow(x.qrels, SAMPLE_RATE, SEED)
    out = CV.interpolate(x.search_run, x.reranked("max"), x.folds(5), sampled, x.qrels,
                         folds_bound=_folds_bound(x), q_bound=x.n_topics, pooled=True)
    return out.select("metric", r6("value").alias("value"), "n_queries")


# ------------------------------------------------------------------ X8 experiment matrix
def _matrix_sql() -> str:
    pq = O.per_query_sql("(SELECT a.*, f.fold FROM all_reranked a JOIN folds5 f ON a.qid = f.qid WHERE f.split = 'test')",
                         group=("scorer", "agg", "fold"))
    means = f"""
SELECT scorer, agg, fold, metric, avg(value) AS value FROM (
  UNPIVOT (SELECT * FROM {pq} p) ON {METRIC_COLS} INTO NAME metric VALUE value)
GROUP BY scorer, agg, fold, metric"""
    cols = ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN value END), 6) AS {m}" for m in E.DEFAULT_METRICS)
    return f"""
SELECT scorer, agg, fold, CAST(level AS INTEGER) AS level, {cols} FROM (
  SELECT metric, scorer, agg, fold, avg(value) AS value, GROUPING(metric, scorer, agg, fold) AS level
  FROM ({means}) GROUP BY ROLLUP (metric, scorer, agg, fold))
WHERE metric IS NOT NULL
GROUP BY scorer, agg, fold, level
"""


@register("experiment_matrix", O.sql(_matrix_sql(), "all_reranked", "folds5", "qrels"))
def q_experiment_matrix(spark, sf_dir):
    """Test means over scorer x aggregation x fold, a column per metric, with
    roll-up subtotals per (scorer, agg) and per scorer and overall."""
    x = X(spark, sf_dir)
    runs = B.split_run(all_reranked(x), x.folds(5), _folds_bound(x), ("test",))
    keys = ["scorer", "agg", "fold"]
    means = E.mean_metrics(E.eval_run(runs, x.qrels, E.DEFAULT_METRICS, 1, keys, x.n_topics), keys)
    m = CV.experiment_matrix(means, keys, E.DEFAULT_METRICS, subtotals=True)
    return m.select(*keys, F.col("level").cast("int").alias("level"),
                    *[r6(c).alias(c) for c in E.DEFAULT_METRICS])


# ------------------------------------------------------------------ X8 over the sampling grid
SAMPLING_METRICS = ("map", "ndcg_cut_20")
# a query of one sampled set is a query of its own, so that each set judges by its own labels
O.cte("grid_dev", ("folds5", "qrels"), f"""
SELECT mode, rate, fold, qid AS topic, mode || '|' || set_name || '|' || fold || '|' || qid AS qid, docid, rel
FROM ({grid_union_sql()}) WHERE split = 'dev'
""")
O.cte("grid_runs", ("grid_dev", "all_reranked"), """
SELECT g.mode, g.rate, g.fold, a.scorer, a.agg, g.qid, a.docid, a.rank
FROM (SELECT DISTINCT mode, rate, fold, topic, qid FROM grid_dev) g JOIN all_reranked a ON a.qid = g.topic
""")


def _sampling_matrix_sql() -> str:
    keys = "mode, rate, scorer, agg, fold"
    pq = O.per_query_sql("grid_runs", "grid_dev", ks_p=(), ks_judged=(), group=tuple(keys.split(", ")))
    cols = ", ".join(f"round(avg({m}), 6) AS {m}" for m in SAMPLING_METRICS)
    return f"SELECT {keys}, {cols}, CAST(count(*) AS BIGINT) AS n_queries FROM {pq} p GROUP BY {keys}"


@register("sampling_matrix", O.sql(_sampling_matrix_sql(), "grid_runs", "grid_dev"))
def q_sampling_matrix(spark, sf_dir):
    """X8 with the sampling experiment: dev means over mode x rate x scorer x aggregation x
    fold, each cell judged by its own sampled set."""
    x = X(spark, sf_dir)
    numbered = B.numbered_judgments(x.qrels, B.RATES, SEED)

    def grid(**of) -> DataFrame:
        g = B.sample_grid(x.qrels, x.folds(5), B.RATES, B.MODES, SEED, x.n_topics * 5, numbered, **of)
        return g.filter(F.col("split") == "dev").withColumnRenamed("qid", "topic")

    name = F.concat_ws("|", "mode", "set_name", "fold", "topic").alias("qid")
    # the judgments of all sets are counted; only those of the cut's documents are joined
    counts = checkpoint(grid(counted=["rel"]).groupBy("mode", "rate", "set_name", "fold", "topic", "rel").agg(F.sum("n").alias("n")))
    levels = counts.groupBy(name, "rel").agg(F.sum("n").alias("n"))
    labels = checkpoint(grid(run=x.cut).select(name, "docid", "rel"))
    sets = counts.select("mode", "rate", "fold", "topic", name).distinct()
    bound = x.n_topics * len(B.RATES) * len(B.MODES)  # every topic is dev in one fold
    runs = (all_reranked(x).withColumnRenamed("qid", "topic").join(broadcast_bounded(sets, bound), "topic").drop("topic"))
    keys = ["mode", "rate", "scorer", "agg", "fold"]
    wide = E.per_query(runs, labels, SAMPLING_METRICS, 1, keys, bound, levels)
    return wide.groupBy(*keys).agg(*[r6(F.avg(m)).alias(m) for m in SAMPLING_METRICS], F.count(F.lit(1)).alias("n_queries"))
