"""File-format round trips (S1, S3-S9): derived tables are written in the real
formats into a fresh folder under the shared checkpoint folder, read back with
the readers, and compared with the oracle's direct computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crossval as CV
from ..operators import metrics as E
from ..operators import rerank as K
from ..operators.labels import labels_of
from ..session import checkpoint, scratch_dir
from ..sources import files as S
from ..sources import testbed
from ..sources.publish import publish, read_all, read_best
from . import oracle as O
from .q_text import _sql_html_to_text, _sql_squash
from .registry import X, r6, register

SHARDS = 4
RUN_ID = "bm25_k1=0.90_b=0.40"


@register("io_trecweb", O.sql(f"SELECT CAST(page_id AS VARCHAR) AS docid, {_sql_html_to_text('html')} AS text, "
                              "CAST(NULL AS VARCHAR) AS parse_error FROM pages"))
def q_io_trecweb(spark, sf_dir):
    """S1 + T1 + T2: pages written as gzip trec-web shards, scanned back, parsed, cleaned."""
    path = scratch_dir(spark, "trecweb")
    pages = testbed.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("docid"), "url", "html",
        (F.col("page_id") % SHARDS).alias("shard"))
    S.write_trecweb(pages, path, shard_col="shard")
    docs = S.read_trecweb(spark, path)
    return docs.select("docid", T.html_to_text("html").alias("text"), "parse_error")


# Ids of a sharded corpus: 50 documents a shard, 10 shards a folder.
FETCH_DEPTH = 10


def _shard_id():
    d = F.col("doc_id")
    return F.format_string("GX%03d-%02d-%07d", F.floor(d / 500), F.floor(d / 50) % 10, d)


@register("fetch_docs_shards", O.sql(f"""
SELECT printf('GX%03d-%02d-%07d', doc_id // 500, (doc_id // 50) % 10, doc_id) AS docid,
       printf('GX%03d/%02d.gz', doc_id // 500, (doc_id // 50) % 10) AS shard, md5({_sql_squash('text')}) AS text_md5
FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT docid FROM run WHERE rank <= {FETCH_DEPTH})
""", "run"))
def q_fetch_docs_shards(spark, sf_dir):
    """L2 + S1 + T5: the corpus as gzip shards; the documents of a run's first ranks are
    fetched from their own shards."""
    x = X(spark, sf_dir)
    root = scratch_dir(spark, "shards")
    docs = x.docs.select(_shard_id().alias("docid"), F.lit("").alias("url"), F.col("text").alias("html"))
    S.write_shards(docs, root)
    first = x.search_run.filter(F.col("rank") <= FETCH_DEPTH).select(F.col("docid").cast("long").alias("doc_id"))
    got = S.fetch_from_shards(spark, root, first.select(_shard_id().alias("docid")), x.n_topics * FETCH_DEPTH)
    return got.select("docid", T.split_docid("docid").getField("shard").alias("shard"), F.md5(T.squash_ws("html")).alias("text_md5"))


@register("io_qrels", O.sql("SELECT qid, docid, rel, CAST(NULL AS VARCHAR) AS parse_error FROM qrels", "qrels"))
def q_io_qrels(spark, sf_dir):
    """S3: qrels text file round trip."""
    path = scratch_dir(spark, "qrels")
    S.write_qrels(X(spark, sf_dir).qrels, path)
    return S.read_qrels(spark, path)


@register("io_topics", O.sql(f"""
SELECT qid, 'title' AS query_type, query FROM title
UNION ALL
SELECT qid, 'desc' AS query_type, {_sql_squash('text')} AS query FROM ttok
""", "title", "ttok"))
def q_io_topics(spark, sf_dir):
    """Trec topic file (title + description) round trip."""
    x = X(spark, sf_dir)
    path = scratch_dir(spark, "topics")
    t = x.title.select("qid", F.col("query").alias("title")).join(
        x.desc.select("qid", F.col("query").alias("desc")), "qid")
    S.write_topics(t, path)
    return S.read_topics(spark, path)


@register("io_folds", O.sql("SELECT * FROM folds5", "folds5"))
def q_io_folds(spark, sf_dir):
    """Fold JSON round trip (set semantics)."""
    path = scratch_dir(spark, "folds")
    S.write_folds(X(spark, sf_dir).folds(5), path)
    return S.read_folds(spark, path)


@register("io_run", O.sql(f"""
SELECT '{RUN_ID}' AS run_id, qid, docid, rank, round(score, 6) AS score, true AS params_ok FROM run
""", "run"))
def q_io_run(spark, sf_dir):
    """S6 + S7 + S8: the BM25 run as a trec run file, read back with the parameter guard."""
    path = scratch_dir(spark, "run")
    S.write_run(X(spark, sf_dir, False).search_run, path, RUN_ID)
    r = S.read_run(spark, path, expect={"k1": 0.9, "b": 0.4})
    return r.select("run_id", "qid", "docid", "rank", r6("score").alias("score"), "params_ok")


@register("io_run_folders", O.sql("""
SELECT 'maxp' AS run_id, f.fold, f.split, m.qid, m.docid, m.rank, round(m.score, 6) AS score
FROM maxp m JOIN folds5 f ON f.qid = m.qid WHERE f.split IN ('dev', 'test')
""", "maxp", "folds5"))
def q_io_run_folders(spark, sf_dir):
    """Predictions of every fold in their own folders, read back with the folders' values."""
    x = X(spark, sf_dir)
    runs = CV.assemble_runs(x.reranked("max"), x.folds(5), ("dev", "test"), x.n_topics * 5)
    path = scratch_dir(spark, "run-folders")
    S.write_run(runs, path, "maxp", ("fold", "split"))
    back = S.read_run(spark, path, partition_cols=("fold", "split"))
    return back.select("run_id", "fold", "split", "qid", "docid", "rank", r6("score").alias("score"))


def _best_sql() -> str:
    """The run of the aggregation with the greatest mean nDCG@20, the first of equal ones."""
    runs = "\nUNION ALL\n".join(f"""
SELECT {i} AS seq, '{how}' AS job, qid, docid, score_{how} AS score,
       CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score_{how}, 6) DESC, docid DESC) AS INTEGER) AS rank
FROM agg_bm25""" for i, how in enumerate(K.AGGREGATIONS))
    return f"""
, all_agg AS ({runs}),
means AS (SELECT seq, job, round(avg(ndcg_cut_20), 9) AS value FROM {O.per_query_sql('all_agg', group=('seq', 'job'))} pq GROUP BY seq, job)
SELECT job, qid, docid, rank, round(score, 6) AS score FROM all_agg
WHERE job = (SELECT job FROM means ORDER BY value DESC, seq LIMIT 1)
"""


@register("io_best_run", O.sql(_best_sql(), "agg_bm25", "qrels").replace("\n, all_agg", ",\nall_agg"))
def q_io_best_run(spark, sf_dir):
    """The runs of all aggregations are published with their nDCG@20 as one name; what is
    read under it is the best one's.  Every job is run twice; the second time adds nothing."""
    x = X(spark, sf_dir)
    root = scratch_dir(spark, "published")
    agg = checkpoint(K.aggregate_scores(x.passage_scores()))
    # the judgments are read once for all jobs: counted, and those of the scored documents kept
    levels, labels = E.judged_levels(x.qrels), checkpoint(labels_of(agg, x.qrels))
    for how in K.AGGREGATIONS * 2:
        run = checkpoint(K.rerank(agg.select("qid", "docid", F.col(f"score_{how}").alias("score"))))
        mean = E.mean_metrics(E.eval_run(run, labels, ["ndcg_cut_20"], q_bound=x.n_topics, levels=levels)).first()
        publish(run, root, "test.best", how, round(mean.value, 9))
    return read_best(spark, root, "test.best").select("job", "qid", "docid", "rank", r6("score").alias("score"))


@register("io_metrics_rerun", O.sql(f"""
SELECT job, metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries FROM (
  SELECT 'search' AS job, * FROM (UNPIVOT (SELECT * FROM {O.per_query_sql('run')} pq)
    ON map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200 INTO NAME metric VALUE value)
  UNION ALL
  SELECT 'maxp' AS job, * FROM (UNPIVOT (SELECT * FROM {O.per_query_sql('maxp')} pq)
    ON map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200 INTO NAME metric VALUE value))
GROUP BY job, metric
""", "run", "maxp", "qrels"))
def q_io_metrics_rerun(spark, sf_dir):
    """Metric rows of two jobs, each run twice; every row is there once."""
    x = X(spark, sf_dir)
    root = scratch_dir(spark, "published")
    for job, run in (("search", x.search_run), ("maxp", x.reranked("max"))):
        m = checkpoint(E.mean_metrics(E.eval_run(run, x.qrels, q_bound=x.n_topics)))
        publish(m, root, "metrics", job)
        publish(m, root, "metrics", job)
    return read_all(spark, root, "metrics").select("job", "metric", r6("value").alias("value"), "n_queries")


@register("io_metrics", O.sql(f"""
SELECT '{RUN_ID}' AS run_id, metric, round(avg(value), 6) AS value, CAST(count(*) AS BIGINT) AS n_queries FROM (
  UNPIVOT (SELECT * FROM {O.per_query_sql('run')} pq)
  ON map, bpref, P_20, ndcg_cut_20, judged_10, judged_20, judged_200 INTO NAME metric VALUE value)
GROUP BY metric
""", "run", "qrels"))
def q_io_metrics(spark, sf_dir):
    """Metric rows appended to a partitioned parquet table and read back."""
    x = X(spark, sf_dir)
    path = scratch_dir(spark, "metrics")
    m = E.mean_metrics(E.eval_run(x.search_run, x.qrels, q_bound=x.n_topics)).withColumn("run_id", F.lit(RUN_ID))
    S.write_metrics(m, path)
    back = spark.read.parquet(path)
    return back.select("run_id", "metric", r6("value").alias("value"), "n_queries")
