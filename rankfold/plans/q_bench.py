"""Parameter sweep, best run, and benchmark preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import crossval as CV
from ..operators import metrics as E
from ..operators import rerank as K
from ..operators.labels import labels_of
from ..operators.retrieve import best_run_per_fold, bm25_sweep, rank_within
from ..operators.sizing import broadcast_bounded
from ..session import checkpoint
from . import oracle as O
from .registry import X, r6, register

SEED = 42
SAMPLE_RATE = 0.5
# Fixed sweep grid (k1, b) for the sweep queries.
SWEEP_GRID = ((0.9, 0.4), (0.9, 0.75), (1.2, 0.4), (1.2, 0.75))


# ------------------------------------------------------------------ oracle CTEs
def folds_sql(n: int) -> str:
    return f"""
SELECT 's' || i AS fold,
       CASE WHEN b = i THEN 'test' WHEN b = (CASE WHEN i = 1 THEN {n} ELSE i - 1 END) THEN 'dev' ELSE 'train' END AS split,
       qid
FROM (SELECT CAST(item_id AS VARCHAR) AS qid, item_id % {n} + 1 AS b, unnest(range(1, {n} + 1)) AS i FROM benchmark)
"""


O.cte("folds5", (), folds_sql(5))
O.cte("folds3", (), folds_sql(3))


def md5key(*parts: str) -> str:
    return "md5(concat_ws('|', '" + str(SEED) + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def keep_n(n: str, rate: float) -> str:
    return f"greatest(1, CAST(round(CAST({rate} AS DOUBLE) * {n}) AS BIGINT))"


def deep_sql(rate: float, folds: str = "folds5") -> str:
    if rate >= 1:
        return f"SELECT fold, split, qid FROM {folds}"
    return f"""
SELECT fold, split, qid FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, split ORDER BY {md5key('fold', 'split', 'qid')}) AS r,
         count(*) OVER (PARTITION BY fold, split) AS n FROM {folds})
WHERE split = 'test' OR r <= {keep_n('n', rate)}
"""


def shallow_sql(rate: float, qrels: str = "qrels") -> str:
    if rate >= 1:
        return f"SELECT qid, docid, rel FROM {qrels}"
    return f"""
SELECT qid, docid, rel FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {md5key('qid', 'docid')}) AS r,
         count(*) OVER (PARTITION BY qid) AS n FROM {qrels})
WHERE r <= {keep_n('n', rate)}
"""


O.cte("shallow50", ("qrels",), shallow_sql(SAMPLE_RATE))


def sweep_scored_sql() -> str:
    parts = []
    for k1, b in SWEEP_GRID:
        rid = f"bm25_k1={k1:.2f}_b={b:.2f}"
        parts.append(f"SELECT '{rid}' AS run_id, * FROM ({O.bm25_scored(str(k1), str(b))})")
    return "\nUNION ALL\n".join(parts)


O.cte("sweep_scored", ("qtf", "qw", "coll"), sweep_scored_sql())
O.cte("sweep", ("sweep_scored",), """
SELECT run_id, qid, docid, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY round(score, 6) DESC, docid DESC) AS rank
  FROM sweep_scored) WHERE rank <= 1000
""")


# ------------------------------------------------------------------ R4 / R5
@register("bm25_sweep", O.sql("SELECT run_id, qid, docid, rank, round(score, 6) AS score FROM sweep", "sweep"))
def q_bm25_sweep(spark, sf_dir):
    """Four (k1, b) runs from one set of term hits."""
    x = X(spark, sf_dir)
    run = bm25_sweep(None, None, SWEEP_GRID, parts=x.parts)
    return run.select("run_id", "qid", "docid", "rank", r6("score").alias("score"))


def _sweep_dev_sql() -> str:
    pq = O.per_query_sql("sweep_dev", group=("run_id", "fold", "split"))
    return f"""
SELECT fold, run_id, 'ndcg_cut_20' AS metric, round(value, 6) AS value FROM (
  SELECT fold, run_id, value,
         row_number() OVER (PARTITION BY fold ORDER BY round(value, 9) DESC, run_id ASC) AS r
  FROM (SELECT run_id, fold, avg(ndcg_cut_20) AS value FROM {pq} pq GROUP BY run_id, fold))
WHERE r = 1
"""


O.cte("sweep_dev", ("sweep", "folds5"), """
SELECT s.run_id, f.fold, f.split, s.qid, s.docid, s.rank FROM sweep s JOIN folds5 f ON s.qid = f.qid
WHERE f.split = 'dev'
""")


@register("best_run_per_fold", O.sql(_sweep_dev_sql(), "sweep_dev", "qrels"))
def q_best_run_per_fold(spark, sf_dir):
    """The sweep run with the best dev nDCG@20 in every fold."""
    x = X(spark, sf_dir)
    run = checkpoint(bm25_sweep(None, None, SWEEP_GRID, parts=x.parts))
    folds = x.folds(5)
    tagged = B.split_run(run, folds, x.n_topics * 5, ("dev",))
    means = E.mean_metrics(E.eval_run(tagged, x.qrels, ["ndcg_cut_20"], 1, ["run_id", "fold", "split"], x.n_topics),
                           ["run_id", "fold", "split"])
    best = best_run_per_fold(means, "ndcg_cut_20", "dev")
    return best.select("fold", "run_id", "metric", r6("value").alias("value"))


# ------------------------------------------------------------------ B1 / B2 / B3
@register("folds5", O.sql("SELECT * FROM folds5", "folds5"))
def q_folds5(spark, sf_dir):
    return X(spark, sf_dir).folds(5)


@register("folds3", O.sql("SELECT * FROM folds3", "folds3"))
def q_folds3(spark, sf_dir):
    return X(spark, sf_dir).folds(3)


@register("fold_select", O.sql("SELECT * FROM folds5 WHERE fold IN ('s1', 's3')", "folds5"))
def q_fold_select(spark, sf_dir):
    """B2: ``s1-s3`` selects folds s1 and s3 (a list, not a range)."""
    return B.select_folds(X(spark, sf_dir).folds(5), "s1-s3")


@register("split_run", O.sql("""
SELECT f.fold, f.split, r.qid, r.docid, r.rank FROM run r JOIN folds5 f ON r.qid = f.qid
""", "run", "folds5"))
def q_split_run(spark, sf_dir):
    """Every run row tagged once per fold with the query's split."""
    x = X(spark, sf_dir, False)
    return B.split_run(x.search_run, x.folds(5), x.n_topics * 5).select("fold", "split", "qid", "docid", "rank")


# ------------------------------------------------------------------ B4 / B5 / B6 / B7
@register("deep_sample", O.sql(deep_sql(SAMPLE_RATE), "folds5"))
def q_deep_sample(spark, sf_dir):
    """Half of every train/dev query list, test untouched."""
    return B.sample_deep(X(spark, sf_dir).folds(5), SAMPLE_RATE, SEED)


@register("shallow_sample", O.sql("SELECT * FROM shallow50", "shallow50"))
def q_shallow_sample(spark, sf_dir):
    """Half of every query's judgments (at least one)."""
    return B.sample_shallow(X(spark, sf_dir).qrels, SAMPLE_RATE, SEED)


def grid_union_sql() -> str:
    parts = []
    for mode in B.MODES:
        for rate in B.RATES:
            if mode == "deep":
                f, q = f"({deep_sql(rate)})", "qrels"
            else:
                f, q = "folds5", f"({shallow_sql(rate)})"
            parts.append(f"""
SELECT '{mode}' AS mode, CAST({rate} AS DOUBLE) AS rate, '{B.rate_name(mode, rate)}' AS set_name,
       f.fold, f.split, f.qid, q.docid, q.rel
FROM {f} f JOIN {q} q ON f.qid = q.qid WHERE f.split <> 'test'""")
    return "\nUNION ALL\n".join(parts)


def _grid_sql() -> str:
    g = grid_union_sql()
    return f"""
SELECT mode, rate, set_name, fold, split, CAST(count(DISTINCT qid) AS BIGINT) AS n_qids,
       CAST(count(*) AS BIGINT) AS n_judged, CAST(sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_rel
FROM ({g}) GROUP BY mode, rate, set_name, fold, split
"""


@register("sample_grid", O.sql(_grid_sql(), "folds5", "qrels"))
def q_sample_grid(spark, sf_dir):
    """The whole (mode x rate) grid in one job, summarised per fold and split."""
    x = X(spark, sf_dir)
    g = B.sample_grid(x.qrels, x.folds(5), B.RATES, B.MODES, SEED, x.n_topics * 5, counted=["rel"])
    # a query's rows are summed first, so that counting queries repeats none of its judgments
    cell = ["mode", "rate", "set_name", "fold", "split"]
    one = g.groupBy(*cell, "qid").agg(F.sum("n").alias("n_judged"), F.sum(F.when(F.col("rel") >= 1, F.col("n")).otherwise(0)).alias("n_rel"))
    return (one.groupBy(*cell)
            .agg(F.count("qid").alias("n_qids"), F.sum("n_judged").cast("long").alias("n_judged"),
                 F.sum("n_rel").cast("long").alias("n_rel")))


@register("qrels_duality", O.sql("""
SELECT fold, split, qrels_set, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(rel) AS BIGINT) AS n_judged,
       CAST(sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_rel
FROM (
  SELECT t.fold, t.split, t.qrels_set, q.rel FROM
    (SELECT f.fold, f.split, c.qid, c.docid, CASE WHEN f.split = 'test' THEN 'full' ELSE 'sampled' END AS qrels_set
     FROM cut c JOIN folds5 f ON c.qid = f.qid) t
  LEFT JOIN (SELECT 'sampled' AS qrels_set, * FROM shallow50 UNION ALL SELECT 'full' AS qrels_set, * FROM qrels) q
    ON t.qrels_set = q.qrels_set AND t.qid = q.qid AND t.docid = q.docid)
GROUP BY fold, split, qrels_set
""", "cut", "folds5", "shallow50", "qrels"))
def q_qrels_duality(spark, sf_dir):
    """train/dev rows see the sampled qrels, test rows the full ones."""
    x = X(spark, sf_dir)
    tagged = B.split_run(x.cut.select("qid", "docid"), x.folds(5), x.n_topics * 5)
    j = B.qrels_for_split(tagged, B.sample_shallow(x.qrels, SAMPLE_RATE, SEED), x.qrels)
    return (j.groupBy("fold", "split", "qrels_set")
            .agg(F.count(F.lit(1)).alias("n_pairs"), F.count("rel").alias("n_judged"),
                 F.sum(F.when(F.col("rel") >= 1, 1).otherwise(0)).cast("long").alias("n_rel")))


# ------------------------------------------------------------------ B8 / B9 / B10
def checks_sql(folds: str, qrels: str) -> str:
    return f"""
SELECT 'split_overlap' AS "check", fold, qid, array_to_string(list_sort(list(DISTINCT split)), ',') AS detail
FROM {folds} GROUP BY fold, qid HAVING count(DISTINCT split) > 1
UNION ALL
SELECT 'test_repeated', NULL, qid, array_to_string(list_sort(list(fold)), ',')
FROM (SELECT DISTINCT fold, qid FROM {folds} WHERE split = 'test') GROUP BY qid HAVING count(*) > 1
UNION ALL
SELECT 'test_missing', NULL, qid, NULL FROM (SELECT DISTINCT qid FROM title)
WHERE qid NOT IN (SELECT qid FROM {folds} WHERE split = 'test')
UNION ALL
SELECT 'unjudged_topic', NULL, qid, NULL FROM (SELECT DISTINCT qid FROM title)
WHERE qid NOT IN (SELECT qid FROM {qrels})
UNION ALL
SELECT 'unknown_qrels_qid', NULL, qid, NULL FROM (SELECT DISTINCT qid FROM {qrels})
WHERE qid NOT IN (SELECT qid FROM title)
"""


# Faults put into the derived benchmark: topics whose id is divisible by 7 leave their test
# set, those divisible by 11 enter the test set of s1, those divisible by 13 lose their
# judgments, and judgments of those divisible by 3 are repeated under an unknown id.
O.cte("faulty_folds", ("folds5",), """
SELECT * FROM folds5 WHERE NOT (split = 'test' AND CAST(qid AS BIGINT) % 7 = 0)
UNION ALL SELECT DISTINCT 's1', 'test', qid FROM folds5 WHERE CAST(qid AS BIGINT) % 11 = 0
""")
O.cte("faulty_qrels", ("qrels",), """
SELECT qid, docid, rel FROM qrels WHERE CAST(qid AS BIGINT) % 13 <> 0
UNION ALL SELECT 'no-' || qid, docid, rel FROM qrels WHERE CAST(qid AS BIGINT) % 3 = 0
""")


@register("benchmark_faults", O.sql(checks_sql("faulty_folds", "faulty_qrels"), "faulty_folds", "faulty_qrels", "title"))
def q_benchmark_faults(spark, sf_dir):
    """B8 on a benchmark with faults of all five kinds."""
    x = X(spark, sf_dir)
    n = F.col("qid").cast("long")
    folds, qrels = x.folds(5), x.qrels
    folds = folds.filter(~((F.col("split") == "test") & (n % 7 == 0))).unionByName(
        folds.filter(n % 11 == 0).select(F.lit("s1").alias("fold"), F.lit("test").alias("split"), "qid").distinct())
    qrels = qrels.filter(n % 13 != 0).unionByName(
        qrels.filter(n % 3 == 0).withColumn("qid", F.concat(F.lit("no-"), "qid")))
    return B.check_benchmark(folds, qrels, x.title)


@register("benchmark_checks", O.sql(checks_sql("folds5", "qrels"), "folds5", "title", "qrels"))
def q_benchmark_checks(spark, sf_dir):
    x = X(spark, sf_dir)
    return B.check_benchmark(x.folds(5), x.qrels, x.title)


@register("binarize", O.sql("SELECT qid, docid, rel, rel >= 1 AS relevant FROM qrels", "qrels"))
def q_binarize(spark, sf_dir):
    return E.binarize(X(spark, sf_dir).qrels, 1)


O.cte("descq", ("ttok",), "SELECT qid, item_id, text AS query FROM ttok")


@register("topics_desc", O.sql("SELECT qid, query FROM descq", "descq"))
def q_topics_desc(spark, sf_dir):
    """The description variant of the topics."""
    return X(spark, sf_dir).desc.select("qid", "query")



# ------------------------------------------------------------------ R5 -> K1 -> K4-K8 -> X1
def _fold_best_sql() -> str:
    g = ("fold", "split")
    dev = O.per_query_sql("(SELECT * FROM fold_maxp WHERE split = 'dev')", "shallow50", group=g)
    test = O.per_query_sql("(SELECT * FROM fold_maxp WHERE split = 'test')", "qrels", group=g)
    return f"""
SELECT fold, split, metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries FROM (
  UNPIVOT (SELECT * FROM (SELECT * FROM {dev} d UNION ALL SELECT * FROM {test} t) pq)
  ON map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200 INTO NAME metric VALUE value)
GROUP BY fold, split, metric
"""


O.cte("fold_cut", ("sweep", "sweep_dev", "folds5", "qrels"), f"""
SELECT f.fold, f.split, s.qid, s.docid
FROM sweep s JOIN ({_sweep_dev_sql()}) b ON b.run_id = s.run_id
JOIN folds5 f ON f.fold = b.fold AND f.qid = s.qid AND f.split IN ('dev', 'test')
WHERE s.rank <= 100
""")
O.cte("fold_docs", ("fold_cut", "dtok"), "SELECT docid, tokens FROM dtok WHERE docid IN (SELECT docid FROM fold_cut)")
O.cte("fold_pass", ("fold_docs",), O.passages_of("fold_docs"))
O.cte("fold_scores", ("fold_cut", "fold_pass", "qw"), """
SELECT qid, docid, max(score) AS score FROM (
  SELECT qid, docid, pidx,
         coalesce(sum(qw * (tfp / (tfp + CAST(0.9 AS DOUBLE) * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * pl / CAST(150.0 AS DOUBLE))))), 0.0) AS score
  FROM (SELECT p.qid, p.docid, p.pidx, len(p.ptokens) AS pl, w.qw,
               CAST(len(list_filter(p.ptokens, lambda x: x = w.term)) AS DOUBLE) AS tfp
        FROM (SELECT c.qid, f.* FROM (SELECT DISTINCT qid, docid FROM fold_cut) c JOIN fold_pass f USING (docid)) p
        LEFT JOIN qw w ON w.qid = p.qid)
  GROUP BY qid, docid, pidx)
GROUP BY qid, docid
""")
O.cte("fold_maxp", ("fold_cut", "fold_scores"), """
SELECT fold, split, qid, docid, score,
       CAST(row_number() OVER (PARTITION BY fold, split, qid ORDER BY round(score, 6) DESC, docid DESC) AS INTEGER) AS rank
FROM fold_cut JOIN fold_scores USING (qid, docid)
""")


@register("fold_best_rerank", O.sql(_fold_best_sql(), "fold_maxp", "shallow50", "qrels"))
def q_fold_best_rerank(spark, sf_dir):
    """Per fold: the sweep run that is best on dev (R5), its cut (K1), MaxP reranked, and
    the dev and test means (X1).  Pairs that several folds share are scored once."""
    x = X(spark, sf_dir)
    folds = x.folds(5)
    run = checkpoint(bm25_sweep(None, None, SWEEP_GRID, parts=x.parts))
    dev = B.split_run(run, folds, x.n_topics * 5, ("dev",))
    keys = ["run_id", "fold", "split"]
    # the judgments are read once for both evaluations of the sweep's documents
    levels, labels = E.judged_levels(x.qrels), checkpoint(labels_of(run, x.qrels))
    best = best_run_per_fold(E.mean_metrics(E.eval_run(dev, labels, ["ndcg_cut_20"], 1, keys, x.n_topics, levels), keys))
    chosen = K.cut_run(run).join(broadcast_bounded(best.select("fold", "run_id"), 5), "run_id")
    mine = folds.filter(F.col("split").isin("dev", "test")).select("fold", "qid")
    cut = checkpoint(chosen.join(broadcast_bounded(mine, x.n_topics * 5), ["fold", "qid"]).select("fold", "qid", "docid"))
    scored = cut.join(x.maxp_of(cut, x.cut_bound * len(SWEEP_GRID)), ["qid", "docid"])
    ranked = checkpoint(rank_within(scored, ["fold", "qid"], "score"))
    sampled = B.sample_shallow(x.qrels, SAMPLE_RATE, SEED)
    m = CV.fold_metrics(ranked, folds, sampled, labels, folds_bound=x.n_topics * 5, q_bound=x.n_topics, full_levels=levels)
    return m.select("fold", "split", "metric", r6("value").alias("value"), "n_queries")
