"""Reranking queries beyond the core chain: cut, labelled pairs, triplets,
training-passage subsample, token budget, scorer comparison (K1-K5, T7, K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import network
from ..functions import text as T
from ..functions.subwords import budget_subwords, read_pieces
from ..operators import benchmark as B
from ..operators import metrics as E
from ..operators import rerank as K
from . import oracle as O
from . import q_core  # noqa: F401  (its tables)
from .q_bench import md5key
from .registry import X, r6, register

SEED = 42
PER_POSITIVE = 2


@register("cut_run", O.sql("SELECT qid, docid, rank, round(score, 6) AS score FROM cut", "cut"))
def q_cut_run(spark, sf_dir):
    """K1: the first 100 documents of every query, in run order."""
    return X(spark, sf_dir, False).cut.select("qid", "docid", "rank", r6("score").alias("score"))


@register("pred_pairs", O.sql("""
SELECT c.qid, c.docid, c.rank, q.rel FROM cut c LEFT JOIN qrels q ON c.qid = q.qid AND c.docid = q.docid
""", "cut", "qrels"))
def q_pred_pairs(spark, sf_dir):
    """K2: every cut pair with its label (null when unjudged)."""
    x = X(spark, sf_dir)
    return K.pred_pairs(x.cut.select("qid", "docid", "rank"), x.qrels).select("qid", "docid", "rank", "rel")


O.cte("train_run", ("run", "folds5"), """
SELECT f.fold, r.qid, r.docid FROM run r JOIN folds5 f ON r.qid = f.qid WHERE f.split = 'train'
""")
O.cte("trip", ("train_run", "qrels"), f"""
WITH lab AS (SELECT t.fold, t.qid, t.docid, q.rel FROM train_run t
             LEFT JOIN qrels q ON t.qid = q.qid AND t.docid = q.docid),
pos AS (SELECT fold, qid, docid AS pos_docid FROM lab WHERE rel >= 1),
neg AS (SELECT fold, qid, docid AS neg_docid,
               row_number() OVER (PARTITION BY fold, qid ORDER BY {md5key('qid', 'docid')}) - 1 AS j
        FROM lab WHERE rel IS NULL OR rel < 1),
nneg AS (SELECT fold, qid, count(*) AS n_neg FROM neg GROUP BY fold, qid),
picks AS (
  SELECT fold, qid, pos_docid, (s + t) % n_neg AS j FROM (
    SELECT p.fold, p.qid, p.pos_docid, n.n_neg,
           ('0x' || substr({md5key('p.qid', 'p.pos_docid')}, 1, 8))::BIGINT % n.n_neg AS s,
           unnest(range(0, least({PER_POSITIVE}, n.n_neg))) AS t
    FROM pos p JOIN nneg n ON p.fold = n.fold AND p.qid = n.qid))
SELECT p.fold, p.qid, p.pos_docid, n.neg_docid FROM picks p
JOIN neg n ON p.fold = n.fold AND p.qid = n.qid AND p.j = n.j
""")


@register("triplets", O.sql("SELECT * FROM trip", "trip"))
def q_triplets(spark, sf_dir):
    """K3: (pos, neg) pairs of every fold's training queries from the BM25 run,
    two negatives per positive, no pos x neg product."""
    x = X(spark, sf_dir)
    train = B.split_run(x.search_run.select("qid", "docid"), x.folds(5), x.n_topics * 5, ("train",))
    return K.triplets(train.select("fold", "qid", "docid"), x.qrels, 1, PER_POSITIVE, SEED, ["fold"])


@register("passage_subsample", O.sql(f"""
SELECT docid, pidx, start FROM allpass
WHERE pidx = 0 OR ('0x' || substr({md5key('docid', 'pidx')}, 1, 8))::BIGINT / 4294967296.0 < 0.1
""", "allpass"))
def q_passage_subsample(spark, sf_dir):
    """K5: training passages of every document: passage 0 plus a 10% md5 coin."""
    d = X(spark, sf_dir).docs.select("docid", T.tokenize("text").alias("tokens"))
    p = K.subsample_passages(K.passages(d), K.TRAIN_PASSAGE_PROB, SEED)
    return p.select("docid", "pidx", "start")


O.cte("descpairs", ("ppairs", "descq"), f"""
SELECT p.qid, p.docid, p.pidx, len(p.ptokens) AS n_passage, len({O.tok('d.query')}) AS n_query
FROM ppairs p JOIN descq d ON p.qid = d.qid
""")


@register("token_budget", O.sql("""
SELECT qid, docid, pidx, CAST(n_query AS INTEGER) AS n_query, CAST(n_passage AS INTEGER) AS n_passage,
       CAST(least(n_passage, greatest(0, 253 - n_query)) AS INTEGER) AS n_input
FROM descpairs
""", "descpairs"))
def q_token_budget(spark, sf_dir):
    """Passage tokens that fit a 256-token input next to the description query."""
    x = X(spark, sf_dir)
    dq = x.desc.select("qid", T.tokenize("query").alias("qtokens"))
    pairs = K.passage_pairs(x.cut, x.docs, dq, pair_bound=x.cut_bound, q_bound=x.n_topics)
    b = K.budget_tokens(pairs, K.MAX_SEQ_LEN)
    return b.select("qid", "docid", "pidx", F.size("qtokens").alias("n_query"),
                    F.size("ptokens").alias("n_passage"), F.size("input_tokens").alias("n_input"))


VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@register("token_budget_subwords")
def q_token_budget_subwords(spark, sf_dir):
    """T7 in subwords: leading passage words that fit a 256-subword input next to the
    description query (greedy longest match; no SQL, a test has the brute force)."""
    x = X(spark, sf_dir)
    dq = x.desc.select("qid", T.tokenize("query").alias("qtokens"))
    pairs = K.passage_pairs(x.cut, x.docs, dq, pair_bound=x.cut_bound, q_bound=x.n_topics)
    b = budget_subwords(pairs, read_pieces(vocabulary_path()), K.MAX_SEQ_LEN)
    return b.select("qid", "docid", "pidx", F.size("ptokens").alias("n_passage"), F.size("input_tokens").alias("n_input"))


# ------------------------------------------------------------------ K6 batch scorer
def _network_sql() -> str:
    units = [f"{o} / (1 + exp(-({b} + {' + '.join(f'{w} * x{i}' for i, w in enumerate(ws))})))"
             for ws, b, o in zip(network.WEIGHTS["hidden"], network.WEIGHTS["bias"], network.WEIGHTS["out"])]
    return f"""
SELECT qid, docid, pidx, round({' + '.join(units)}, 6) AS score FROM (
  SELECT p.qid, p.docid, p.pidx, CAST(len(p.ptokens) AS DOUBLE) / 150 AS x0,
         CAST(len(list_intersect(list_distinct(q.qtokens), p.ptokens)) AS DOUBLE) / greatest(1, len(list_distinct(q.qtokens))) AS x1,
         CAST(len(array_to_string(p.ptokens, '')) AS DOUBLE) / greatest(1, len(p.ptokens)) / 10 AS x2
  FROM ppairs p JOIN qtok q ON q.qid = p.qid)
"""


O.cte("qtok", ("title",), f"SELECT qid, {O.tok('query')} AS qtokens FROM title")


@register("passage_scores_batch", O.sql(_network_sql(), "ppairs", "qtok"))
def q_passage_scores_batch(spark, sf_dir):
    """K6: passages scored in Arrow batches by a network that each worker loads once."""
    net = K.batch_scorer(network.load, network.predict, ["qtokens", "ptokens"], "fixed-network")
    s = K.score_passages(X(spark, sf_dir).pairs(), net)
    return s.select("qid", "docid", "pidx", r6("score").alias("score"))


# ------------------------------------------------------------------ K10 scorer comparison
O.cte("pscore_overlap", ("ppairs", "qtok"), """
SELECT p.qid, p.docid, p.pidx,
       CASE WHEN len(list_distinct(q.qtokens)) > 0
            THEN len(list_intersect(list_distinct(q.qtokens), p.ptokens)) / len(list_distinct(q.qtokens))
            ELSE CAST(0.0 AS DOUBLE) END AS score
FROM ppairs p JOIN qtok q ON p.qid = q.qid
""")
O.cte("agg_overlap", ("pscore_overlap",), """
SELECT qid, docid, max(score) AS score_max, min_by(score, pidx) AS score_first,
       sum(score) AS score_sum, avg(score) AS score_avg
FROM pscore_overlap GROUP BY qid, docid
""")


def all_reranked_sql(scorers=("bm25_passage", "overlap")) -> str:
    parts = []
    for sc in scorers:
        src = "agg_bm25" if sc == "bm25_passage" else "agg_overlap"
        for how in K.AGGREGATIONS:
            parts.append(f"""
SELECT '{sc}' AS scorer, '{how}' AS agg, qid, docid, score_{how} AS score,
       CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score_{how}, 6) DESC, docid DESC) AS INTEGER) AS rank
FROM {src}""")
    return "\nUNION ALL\n".join(parts)


O.cte("all_reranked", ("agg_bm25", "agg_overlap"), all_reranked_sql())


def all_reranked(x, scorers=("bm25_passage", "overlap")):
    """Every (scorer, aggregation) run from one passage pass."""
    return K.compare_scored(x.hits_of(x.cut, x.cut_bound, scorers), scorers)


@register("scorer_compare", O.sql(f"""
SELECT scorer, metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries FROM (
  UNPIVOT (SELECT * FROM {O.per_query_sql("(SELECT * FROM all_reranked WHERE agg = 'max')", group=("scorer",))} pq)
  ON map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200 INTO NAME metric VALUE value)
GROUP BY scorer, metric
""", "all_reranked", "qrels"))
def q_scorer_compare(spark, sf_dir):
    """MaxP runs of the BM25-passage and overlap scorers side by side."""
    x = X(spark, sf_dir)
    runs = all_reranked(x).filter(F.col("agg") == "max")
    m = E.mean_metrics(E.eval_run(runs, x.qrels, E.DEFAULT_METRICS, 1, ["scorer"], x.n_topics), ["scorer"])
    return m.select("scorer", "metric", r6("value").alias("value"), "n_queries")
