"""Training-log queries (G1-G4) on the events table, and the pairwise model (K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import rerank as K
from ..operators import trainlog as G
from ..operators import training as TR
from ..operators.retrieve import SEARCH_DEPTH
from ..operators.samples import BATCH, SAMPLES, sample_source, sample_stream
from ..operators.training import DIGITS, RATE, REG
from ..session import checkpoint
from ..sources import testbed
from . import oracle as O
from .q_bench import SAMPLE_RATE, SEED, md5key
from .context import THRESHOLD
from .registry import X, r6, register

ITERSIZE = G.ITERSIZE
FREQ = G.VALIDATE_FREQ


def _train_log(spark, sf_dir):
    return G.train_log_from_events(testbed.table(spark, sf_dir, "events"))


O.cte("train_log", (), """
SELECT event_type AS run_id, value AS loss,
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step
FROM events
""")
O.cte("epochs", ("train_log",), f"""
SELECT run_id, CAST(floor((step - 1) / {ITERSIZE}) AS INTEGER) + 1 AS epoch, loss
FROM train_log
""")
@register("epoch_loss", O.sql("""
SELECT run_id, epoch, round(avg(loss), 6) AS loss, CAST(count(*) AS BIGINT) AS n_steps
FROM epochs GROUP BY run_id, epoch
""", "epochs"))
def q_epoch_loss(spark, sf_dir):
    """G1: mean loss per epoch of every run (steps numbered without a per-run sort task)."""
    e = G.epoch_loss(_train_log(spark, sf_dir), ITERSIZE)
    return e.select("run_id", "epoch", r6("loss").alias("loss"), "n_steps")


# ------------------------------------------------------------------ training by epochs
TRAIN_COLS = ("f_bm25", "f_maxp", "f_firstp", "f_avgp")
SQL_COLS = ", ".join(TRAIN_COLS)

# Training sees the whole search run of the train queries and the sampled judgments.
O.cte("train_lab", ("run", "folds5", "shallow50"), """
SELECT f.fold, r.qid, r.docid, coalesce(q.rel >= 1, false) AS is_pos
FROM run r JOIN folds5 f ON f.qid = r.qid AND f.split = 'train' LEFT JOIN shallow50 q ON q.qid = r.qid AND q.docid = r.docid
""")
O.cte("train_num", ("train_lab",), f"""
SELECT fold, qid, docid, is_pos, row_number() OVER (PARTITION BY fold, qid, is_pos ORDER BY {md5key('qid', 'docid')}) - 1 AS i
FROM train_lab
""")
O.cte("train_q", ("train_lab",), """
SELECT *, row_number() OVER (PARTITION BY fold ORDER BY qid) - 1 AS q, count(*) OVER (PARTITION BY fold) AS n_queries
FROM (SELECT fold, qid, count(*) FILTER (is_pos) AS n_pos, count(*) FILTER (NOT is_pos) AS n_neg
      FROM train_lab GROUP BY fold, qid) WHERE n_pos > 0 AND n_neg > 0
""")
_U = "('0x' || substr(h, {}, 8))::BIGINT"
O.cte("stream", ("train_q", "train_num"), f"""
SELECT d.fold, d.s AS sample, d.qid, p.docid AS pos_docid, n.docid AS neg_docid
FROM (SELECT h.*, q.qid, {_U.format(9)} % q.n_pos AS pi, {_U.format(17)} % q.n_neg AS ni
      FROM (SELECT c.fold, c.n_queries, r.s, md5('{SEED}|' || c.fold || '|' || r.s) AS h
            FROM (SELECT DISTINCT fold, n_queries FROM train_q) c, (SELECT unnest(range(0, {SAMPLES})) AS s) r) h
      JOIN train_q q ON q.fold = h.fold AND q.q = {_U.format(1)} % h.n_queries) d
JOIN train_num p ON p.fold = d.fold AND p.qid = d.qid AND p.is_pos AND p.i = d.pi
JOIN train_num n ON n.fold = d.fold AND n.qid = d.qid AND NOT n.is_pos AND n.i = d.ni
""", once=True)


def _train_run(x):
    train = B.split_run(x.search_run.select("qid", "docid"), x.folds(5), x.n_topics * 5, ("train",))
    return train.select("fold", "qid", "docid")


def _sampled(x):
    return checkpoint(B.sample_shallow(x.qrels, SAMPLE_RATE, SEED))


@register("sample_stream", O.sql("SELECT * FROM stream", "stream"))
def q_sample_stream(spark, sf_dir):
    """K3 with replacement: the whole stream of training samples of every fold."""
    x = X(spark, sf_dir)
    # (read once, so not written)
    return sample_stream(spark, sample_source(_train_run(x), B.sample_shallow(x.qrels, SAMPLE_RATE, SEED), 1, SEED))


# Features of the whole run (BM25 and three aggregations of the passage scores), each
# divided by its greatest value in the query.
O.cte("run_pass", ("run", "dtok"), O.passages_of("(SELECT docid, tokens FROM dtok WHERE docid IN (SELECT docid FROM run))"))
O.cte("run_pscore", ("run", "run_pass", "qw"), O.bm25_passage_of("run", "run_pass"))
O.cte("run_features", ("run", "run_pscore"), f"""
SELECT qid, docid, rank, {', '.join(f'CASE WHEN max({c}) OVER (PARTITION BY qid) > 0 THEN {c} / max({c}) OVER (PARTITION BY qid) ELSE 0.0 END AS {c}' for c in TRAIN_COLS)}
FROM (SELECT r.qid, r.docid, r.rank, r.score AS f_bm25, a.f_maxp, a.f_firstp, a.f_avgp
      FROM run r JOIN (SELECT qid, docid, max(score) AS f_maxp, min_by(score, pidx) AS f_firstp, avg(score) AS f_avgp
                       FROM run_pscore GROUP BY qid, docid) a ON a.qid = r.qid AND a.docid = r.docid)
""", once=True)
O.cte("stream_diffs", ("stream", "run_features"), f"""
SELECT s.fold, s.sample // {ITERSIZE * BATCH} + 1 AS epoch, {', '.join(f'p.{c} - n.{c} AS d_{c}' for c in TRAIN_COLS)}
FROM stream s JOIN run_features p ON p.qid = s.qid AND p.docid = s.pos_docid
JOIN run_features n ON n.qid = s.qid AND n.docid = s.neg_docid
""", once=True)
_MARGIN = " + ".join(["CAST(0 AS DOUBLE)", *[f"w.{c} * s.d_{c}" for c in TRAIN_COLS]])


def _trained_sql() -> str:
    """The weights of every epoch, by recursion over the epochs."""
    def step(c: str) -> str:
        move = f"(CAST({RATE} AS DOUBLE) / sqrt(w.epoch + 1.0))"
        return (f"round(max(w.{c}) * (1 - {move} * CAST({REG} AS DOUBLE)) + {move} * "
                f"sum(CASE WHEN {_MARGIN} < 1 THEN s.d_{c} ELSE 0.0 END) / count(*), {DIGITS}) AS {c}")

    return f"""
WITH RECURSIVE w(fold, epoch, {SQL_COLS}, loss, n_samples) AS (
  SELECT DISTINCT fold, CAST(0 AS BIGINT), {', '.join(['CAST(0 AS DOUBLE)'] * len(TRAIN_COLS))}, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT)
  FROM stream_diffs
  UNION ALL
  SELECT w.fold, w.epoch + 1, {', '.join(step(c) for c in TRAIN_COLS)},
         avg(greatest(0.0, 1 - ({_MARGIN}))) AS loss, count(*) AS n_samples
  FROM w JOIN stream_diffs s ON s.fold = w.fold AND s.epoch = w.epoch + 1 GROUP BY w.fold, w.epoch)
SELECT * FROM w WHERE epoch > 0
"""


O.cte("trained", ("stream_diffs",), _trained_sql(), once=True)
O.cte("dev_ranked", ("trained", "run_features", "folds5"), f"""
SELECT fold, epoch, qid, docid, score,
       CAST(row_number() OVER (PARTITION BY fold, epoch, qid ORDER BY round(score, 6) DESC, docid DESC) AS INTEGER) AS rank
FROM (SELECT w.fold, w.epoch, d.qid, d.docid, {' + '.join(['CAST(0 AS DOUBLE)', *[f'w.{c} * d.{c}' for c in TRAIN_COLS]])} AS score
      FROM run_features d JOIN folds5 f ON f.qid = d.qid AND f.split = 'dev' JOIN trained w ON w.fold = f.fold
      WHERE d.rank <= 100 AND w.epoch % {FREQ} = 0)
""")
O.cte("dev_log", ("dev_ranked", "shallow50"), f"""
SELECT fold AS run_id, CAST(epoch AS INTEGER) AS epoch, metric, avg(value) AS value FROM (
  UNPIVOT (SELECT * FROM {O.per_query_sql('dev_ranked', 'shallow50', ks_p=(20, 5), ks_ndcg=(20, 5), group=('fold', 'epoch'))} pq)
  ON map, bpref, P_20, P_5, ndcg_cut_20, ndcg_cut_5, judged_10, judged_20, judged_200 INTO NAME metric VALUE value)
GROUP BY fold, epoch, metric
""")


def _run_features(x):
    passages = x.hits_of(x.search_run, x.n_topics * SEARCH_DEPTH).withColumnRenamed("bm25_passage", "score")
    agg = K.aggregate_scores(passages).select("qid", "docid", F.col("score_max").alias("f_maxp"),
                                              F.col("score_first").alias("f_firstp"), F.col("score_avg").alias("f_avgp"))
    raw = checkpoint(x.search_run.select("qid", "docid", F.col("score").alias("f_bm25")).join(agg, ["qid", "docid"]))
    return checkpoint(TR.scaled_features(raw, TRAIN_COLS))


def _trained(x):
    """(weights, losses, features, sampled judgments)."""
    sampled, features = _sampled(x), _run_features(x)
    samples = sample_stream(x.spark, sample_source(_train_run(x), sampled, 1, SEED))
    return *TR.train_epochs(TR.sample_differences(samples, features, TRAIN_COLS), TRAIN_COLS), features, sampled


def _dev_log(spark, sf_dir):
    x = X(spark, sf_dir)
    weights, _, features, sampled = _trained(x)
    cut = x.cut.select("qid", "docid").join(features, ["qid", "docid"])
    dev = B.split_run(cut, x.folds(5), x.n_topics * 5, ("dev",)).drop("split")
    return checkpoint(TR.dev_log(weights, dev, sampled, TRAIN_COLS, FREQ, q_bound=x.n_topics))


@register("train_weights", O.sql(f"""
SELECT fold, CAST(epoch AS INTEGER) AS epoch, feature, round(weight, 6) AS weight
FROM (UNPIVOT (SELECT fold, epoch, {SQL_COLS} FROM trained) ON {SQL_COLS} INTO NAME feature VALUE weight)
""", "trained"))
def q_train_weights(spark, sf_dir):
    """K9: weights of every fold after each of 36 epochs over the sample stream."""
    return _trained(X(spark, sf_dir))[0].select("fold", "epoch", "feature", r6("weight").alias("weight"))


@register("train_losses", O.sql("""
SELECT fold, CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS loss, n_samples FROM trained
""", "trained"))
def q_train_losses(spark, sf_dir):
    """G1 of the training above: mean hinge loss of each epoch."""
    return _trained(X(spark, sf_dir))[1].select("fold", "epoch", r6("loss").alias("loss"), "n_samples")


@register("validation_epochs", O.sql("SELECT run_id, epoch, metric, round(value, 6) AS value FROM dev_log", "dev_log"))
def q_validation_epochs(spark, sf_dir):
    """Metrics of the dev queries, reranked with the weights of every 4th epoch."""
    return _dev_log(spark, sf_dir).select("run_id", "epoch", "metric", r6("value").alias("value"))


@register("best_epoch", O.sql("""
SELECT run_id, epoch, metric, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(value, 9) DESC, epoch ASC) AS r
  FROM dev_log WHERE metric = 'ndcg_cut_20') WHERE r = 1
""", "dev_log"))
def q_best_epoch(spark, sf_dir):
    """Each fold's best validated epoch by dev nDCG@20, the earliest on ties."""
    b = G.best_epoch(_dev_log(spark, sf_dir), "ndcg_cut_20", FREQ)
    return b.select("run_id", "epoch", "metric", r6("value").alias("value"))


@register("select_metrics", O.sql("""
SELECT run_id, epoch, 'dev-' || metric AS metric, round(value, 6) AS value FROM dev_log
WHERE metric IN ('map', 'bpref', 'P_20', 'ndcg_cut_20', 'judged_10', 'judged_20', 'judged_200')
""", "dev_log"))
def q_select_metrics(spark, sf_dir):
    """Of the nine dev metrics keep the seven logged names, prefixed ``dev-``."""
    s = G.select_metrics(_dev_log(spark, sf_dir))
    return s.select("run_id", "epoch", "metric", r6("value").alias("value"))


# ------------------------------------------------------------------ K9 pairwise model
FEATURES = ("f_bm25", "f_maxp", "f_firstp", "f_overlap", "f_quality")


def _features(x):
    """Per (qid, docid) of the whole search run: first-stage BM25, MaxP and FirstP of the
    BM25 passage scorer, MaxP of the overlap scorer, and the document's quality label (0
    when unlabelled)."""
    both = x.hits_of(x.search_run, x.n_topics * SEARCH_DEPTH, ("bm25_passage", "overlap"))
    agg = both.groupBy("qid", "docid").agg(F.max("bm25_passage").alias("f_maxp"), F.min_by("bm25_passage", "pidx").alias("f_firstp"),
                                           F.max("overlap").alias("f_overlap"))
    lab = testbed.table(x.spark, x.sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("docid"), F.col("quality").cast("double").alias("q"))
    return (x.search_run.select("qid", "docid", "rank", F.col("score").alias("f_bm25"))
            .join(agg, ["qid", "docid"]).join(lab, "docid", "left")
            .withColumn("f_quality", F.coalesce("q", F.lit(0.0))).drop("q"))


def _fit_all(spark, sf_dir):
    """Triplets of the whole search run of the train queries, by the sampled judgments."""
    from ..operators import pairwise as P

    x = X(spark, sf_dir)
    feats = checkpoint(_features(x))
    trip = K.triplets(_train_run(x), _sampled(x), 1, 2, SEED, ["fold"])
    ex = checkpoint(P.pair_examples(trip, feats, FEATURES, ["fold"]))
    weights = checkpoint(P.fit_pairwise(ex, FEATURES))
    return x, feats.filter(F.col("rank") <= THRESHOLD).drop("rank"), x.folds(5), weights


@register("pairwise_model")
def q_pairwise_model(spark, sf_dir):
    """K9: per-fold RankSVM weights (hinge loss) from training triplets, all folds
    in one iterative fit; no SQL oracle (rows-only check)."""
    return _fit_all(spark, sf_dir)[3]


@register("pairwise_eval")
def q_pairwise_eval(spark, sf_dir):
    """K6 ``linear`` scorer: each fold's model reranks its test queries; test means."""
    from ..operators import metrics as E
    from ..operators import pairwise as P
    from ..operators.retrieve import rank_within

    x, feats, folds, weights = _fit_all(spark, sf_dir)
    test = B.split_run(feats, folds, x.n_topics * 5, ("test",))
    scored = rank_within(P.score_linear(test, weights, FEATURES), ["fold", "qid"], "score")
    m = E.mean_metrics(E.eval_run(scored, x.qrels, E.DEFAULT_METRICS, 1, ["fold"]), ["fold"])
    return m.select("fold", "metric", r6("value").alias("value"), "n_queries")


# K9 without the fit: the examples it is fitted on, and the scorer with fixed weights.
FIXED_WEIGHTS = {"f_bm25": 0.25, "f_maxp": 2.0}
O.cte("pair_features", ("cut", "agg_bm25"), """
SELECT c.qid, c.docid, c.score AS f_bm25, a.score_max AS f_maxp FROM cut c JOIN agg_bm25 a ON a.qid = c.qid AND a.docid = c.docid
""")


def _pair_features(x):
    bm = x.doc_scores("bm25_passage").select("qid", "docid", F.col("score_max").alias("f_maxp"))
    return x.cut.select("qid", "docid", F.col("score").alias("f_bm25")).join(bm, ["qid", "docid"])


# Features of every document that a triplet holds: triplets come from the whole run.
O.cte("trip_docs", ("trip", "run"), """
SELECT r.qid, r.docid, r.score FROM run r
WHERE EXISTS (SELECT 1 FROM trip t WHERE t.qid = r.qid AND (t.pos_docid = r.docid OR t.neg_docid = r.docid))
""")
O.cte("trip_pass", ("trip_docs", "dtok"), O.passages_of(
    "(SELECT docid, tokens FROM dtok WHERE docid IN (SELECT docid FROM trip_docs))"))
O.cte("trip_maxp", ("trip_docs", "trip_pass", "qw"), O.bm25_passage_of("trip_docs", "trip_pass"))
O.cte("trip_features", ("trip_docs", "trip_maxp"), """
SELECT d.qid, d.docid, d.score AS f_bm25, m.f_maxp
FROM trip_docs d JOIN (SELECT qid, docid, max(score) AS f_maxp FROM trip_maxp GROUP BY qid, docid) m
  ON m.qid = d.qid AND m.docid = d.docid
""")


@register("pairwise_examples", O.sql("""
SELECT fold, CAST(label AS DOUBLE) AS label, round(sign_ * (p.f_bm25 - n.f_bm25), 6) AS d_bm25,
       round(sign_ * (p.f_maxp - n.f_maxp), 6) AS d_maxp
FROM trip t JOIN trip_features p ON p.qid = t.qid AND p.docid = t.pos_docid
JOIN trip_features n ON n.qid = t.qid AND n.docid = t.neg_docid,
(VALUES (1, 1.0), (0, -1.0)) s(label, sign_)
""", "trip", "trip_features"))
def q_pairwise_examples(spark, sf_dir):
    """K9: the difference examples of every fold's triplets, both signs.  Triplets are drawn
    from the whole search run, so features are computed for all documents they hold, not
    for the cut only."""
    from ..operators import pairwise as P
    from .q_rerank import PER_POSITIVE

    x = X(spark, sf_dir)
    train = B.split_run(x.search_run.select("qid", "docid"), x.folds(5), x.n_topics * 5, ("train",))
    trip = checkpoint(K.triplets(train.select("fold", "qid", "docid"), x.qrels, 1, PER_POSITIVE, SEED, ["fold"]))
    held = trip.select("qid", F.explode(F.array("pos_docid", "neg_docid")).alias("docid")).distinct()
    maxp = x.maxp_of(held, x.n_topics * SEARCH_DEPTH).select("qid", "docid", F.col("score").alias("f_maxp"))
    feats = x.search_run.select("qid", "docid", F.col("score").alias("f_bm25")).join(maxp, ["qid", "docid"])
    e = P.pair_examples(trip, feats, list(FIXED_WEIGHTS), ["fold"])
    return e.select("fold", "label", r6("d_f_bm25").alias("d_bm25"), r6("d_f_maxp").alias("d_maxp"))


@register("pairwise_linear", O.sql("""
SELECT f.fold, p.qid, p.docid, round(0.25 * p.f_bm25 + 2.0 * p.f_maxp, 6) AS score
FROM pair_features p JOIN folds5 f ON f.qid = p.qid AND f.split = 'test'
""", "pair_features", "folds5"))
def q_pairwise_linear(spark, sf_dir):
    """K6 ``linear`` scorer with fixed weights on every fold's test queries."""
    from ..operators import pairwise as P

    x = X(spark, sf_dir)
    test = B.split_run(_pair_features(x), x.folds(5), x.n_topics * 5, ("test",))
    weights = x.folds(5).select("fold").distinct().select("fold", F.explode(F.array(*[
        F.struct(F.lit(k).alias("feature"), F.lit(v).alias("weight")) for k, v in FIXED_WEIGHTS.items()])).alias("w")).select(
            "fold", "w.*")
    s = P.score_linear(test, weights, list(FIXED_WEIGHTS))
    return s.select("fold", "qid", "docid", r6("score").alias("score"))
