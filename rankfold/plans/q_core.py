"""Core queries: term statistics, BM25, passages, passage scores, aggregation,
rerank, metrics and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as E
from ..operators import rerank as K
from ..operators.corpus import term_stats
from . import oracle as O
from .context import Experiment
from .registry import X, r6, register


# =============================================================== T6 / R1
@register("term_stats", O.sql(
    "SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term",
    "postings"))
def q_term_stats(spark, sf_dir):
    return term_stats(X(spark, sf_dir).docs).terms


@register("doc_lengths", O.sql(
    "SELECT docid, CAST(len(tokens) AS INTEGER) AS dl FROM dtok", "dtok"))
def q_doc_lengths(spark, sf_dir):
    return term_stats(X(spark, sf_dir).docs).doc_len


@register("tokens_count", O.sql("""
SELECT a.lang, a.n_docs, a.n_tokens, CAST(coalesce(b.n_terms, 0) AS BIGINT) AS n_terms
FROM (SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens
      FROM dtok GROUP BY lang) a
LEFT JOIN (SELECT lang, count(DISTINCT term) AS n_terms
           FROM (SELECT lang, unnest(tokens) AS term FROM dtok) GROUP BY lang) b USING (lang)
""", "dtok"))
def q_tokens_count(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", T.tokenize("text").alias("tokens"))
    per_lang = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum(F.size("tokens")).cast("long").alias("n_tokens"))
    terms = (T.explode_terms(d, "lang").distinct()
             .groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms")))
    return per_lang.join(terms, "lang", "left").select(
        "lang", "n_docs", "n_tokens", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))


# =============================================================== R2 / R3
@register("bm25_top", O.sql("SELECT qid, docid, rank, round(score, 6) AS score FROM run", "run"))
def q_bm25_top(spark, sf_dir):
    run = X(spark, sf_dir, False).search_run
    return run.select("qid", "docid", "rank", r6("score").alias("score"))


# =============================================================== K4
O.cte("allpass", ("dtok",), O.passages_of("dtok"))


@register("passages", O.sql(
    "SELECT docid, pidx, start, CAST(len(ptokens) AS INTEGER) AS n_tokens, "
    "md5(array_to_string(ptokens, ' ')) AS text_md5 FROM allpass", "allpass"))
def q_passages(spark, sf_dir):
    """Passages of every document (whole texts)."""
    d = X(spark, sf_dir).docs.select("docid", T.tokenize("text").alias("tokens"))
    p = K.passages(d)
    return p.select("docid", "pidx", "start", F.size("ptokens").alias("n_tokens"),
                    F.md5(F.array_join("ptokens", " ")).alias("text_md5"))


# =============================================================== K6 / K7 / K8
@register("passage_scores", O.sql(
    "SELECT qid, docid, pidx, round(score, 6) AS score FROM pscore_bm25", "pscore_bm25"))
def q_passage_scores(spark, sf_dir):
    s = X(spark, sf_dir).passage_scores()
    return s.select("qid", "docid", "pidx", r6("score").alias("score"))


def _agg_query(how: str):
    def q(spark, sf_dir):
        s = K.aggregate_scores(X(spark, sf_dir).passage_scores(), how)
        return s.select("qid", "docid", r6("score").alias("score"))
    return q


for _how in K.AGGREGATIONS:
    register(f"agg_{_how}", O.sql(
        f"SELECT qid, docid, round(score_{_how}, 6) AS score FROM agg_bm25", "agg_bm25"))(_agg_query(_how))


@register("rerank", O.sql("SELECT qid, docid, rank, round(score, 6) AS score FROM maxp", "maxp"))
def q_rerank(spark, sf_dir):
    r = X(spark, sf_dir).reranked("max")
    return r.select("qid", "docid", "rank", r6("score").alias("score"))


# =============================================================== E1-E7
def _metric_sql(run_cte: str, cols: list[str], *deps: str) -> str:
    body = f"SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM {O.per_query_sql(run_cte)} pq"
    return O.sql(body, run_cte, "qrels", *deps)


def _metric_query(cols: list[str], run: str = "search"):
    def q(spark, sf_dir):
        x = X(spark, sf_dir)
        r = x.search_run if run == "search" else x.reranked("max")
        wide = E.per_query(r, x.qrels, E.DEFAULT_METRICS, q_bound=x.n_topics)
        return wide.select("qid", *[r6(c).alias(c) for c in cols])
    return q


register("p_at_k", _metric_sql("run", ["P_20"]))(_metric_query(["P_20"]))
register("map", _metric_sql("run", ["map"]))(_metric_query(["map"]))
register("ndcg_at_k", _metric_sql("run", ["ndcg_cut_20"]))(_metric_query(["ndcg_cut_20"]))
register("bpref", _metric_sql("run", ["bpref"]))(_metric_query(["bpref"]))
register("judged_at_k", _metric_sql("run", ["judged_10", "judged_20", "judged_200"]))(
    _metric_query(["judged_10", "judged_20", "judged_200"]))

# Flagship: BM25 top-1000 -> top-100 -> passages -> BM25 passage score -> MaxP -> nDCG@20.
register("maxp_ndcg", _metric_sql("maxp", ["ndcg_cut_20"]))(_metric_query(["ndcg_cut_20"], run="maxp"))


@register("desc_maxp_ndcg", O.sql(
    f"SELECT qid, round(ndcg_cut_20, 6) AS ndcg_cut_20 FROM {O.per_query_sql('maxp')} pq", "maxp", "qrels"))
def q_desc_maxp_ndcg(spark, sf_dir):
    """The flagship chain searched with the descriptions (B10).  The derived titles hold
    the same words as the descriptions, so the expected values are the titles'."""
    x = Experiment(spark, sf_dir, query_type="desc")
    wide = E.per_query(x.reranked("max"), x.qrels, E.DEFAULT_METRICS, q_bound=x.n_topics)
    return wide.select("qid", r6("ndcg_cut_20").alias("ndcg_cut_20"))


@register("eval_run", O.sql(f"""
SELECT metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries FROM (
  UNPIVOT (SELECT * FROM {O.per_query_sql('run')} pq)
  ON map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200 INTO NAME metric VALUE value)
GROUP BY metric
""", "run", "qrels"))
def q_eval_run(spark, sf_dir):
    x = X(spark, sf_dir)
    m = E.mean_metrics(E.eval_run(x.search_run, x.qrels, q_bound=x.n_topics))
    return m.select("metric", r6("value").alias("value"), "n_queries")


