"""First-stage retrieval: BM25 (R2), top-k (R3), parameter sweep (R4), best run.

Two scans of the corpus, a statistics one and a scoring one:

    (1) docs - distinct terms - semi join broadcast(query vocabulary)       map side
             - groupBy(term) df; N and the sum of lengths                    vocabulary-sized shuffle
             - small table in the shared folder: df, N, avgdl -> qw = qtf * idf
    (2) docs - tokens - counts of the query vocabulary's terms              map side
             - shuffle by document of these numbers                         the only large shuffle
             - sums over each document's terms, per query                   in the document's task
             - row_number() <= k per qid                                    WindowGroupLimit

The statistics are computed once and also feed the passage scorer.  With the counts of (2)
given (``DocHits``, written once), both read these and the corpus is scanned once.  Topics too
many to broadcast are joined and grouped by (qid, docid) instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import checkpoint
from .corpus import DOC_MARK, all_tokens, vocabulary_hits
from .hits import DocHits, doc_hits, small, vocabulary, weighted_sums
from .sizing import broadcast_bounded

# BM25 parameters of the reference's large-collection runs and depths.
BM25_K1 = 0.9
BM25_B = 0.4
SEARCH_DEPTH = 1000
RANK_DIGITS = 6
MEAN_DIGITS = 9


def rank_within(df: DataFrame, group_cols: Sequence[str] = ("qid",), score_col: str = "score",
                k: int | None = None, digits: int | None = RANK_DIGITS,
                rank_col: str = "rank") -> DataFrame:
    """Ranks 1.. per group by score desc, then docid desc as a string.

    Scores are compared after rounding to ``digits`` so that sums whose last
    bits depend on partitioning give the same ranks on every (re)run.  With
    ``k`` the filter ``rank <= k`` lets Spark plan a WindowGroupLimit, which
    keeps at most k rows per group in every map task before the shuffle, so a
    hot query never sends more than k rows per task.
    """
    s = F.col(score_col)
    key = F.round(s, digits) if digits is not None else s
    w = Window.partitionBy(*group_cols).orderBy(key.desc(), F.col("docid").cast("string").desc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col(rank_col) <= k)
    return out


def top_k(run: DataFrame, k: int = SEARCH_DEPTH, group_cols: Sequence[str] = ("qid",),
          score_col: str = "score") -> DataFrame:
    """The k best documents of every query."""
    return rank_within(run, group_cols, score_col, k=k)


def query_terms(topics: DataFrame, query_col: str = "query",
                group_cols: Sequence[str] = ("qid",)) -> DataFrame:
    """(qid, term, qtf): query tokens with their count in the query."""
    return (topics.select(*group_cols, F.explode(tokenize(query_col)).alias("term"))
            .groupBy(*group_cols, "term").agg(F.count(F.lit(1)).alias("qtf")))


def query_term_bound(topics: DataFrame, query_col: str = "query") -> int:
    """Proven bound of query-term rows: total query length of the (small) topic table."""
    v = topics.select(F.sum(F.size(tokenize(query_col)))).first()[0]
    return int(v or 0)


def idf(n_docs: Column, df: Column) -> Column:
    """Lucene BM25 idf: ln(1 + (N - df + .5) / (df + .5))."""
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_tf_part(tf: Column, dl: Column, avgdl: Column, k1, b) -> Column:
    k1, b = F.lit(k1) if not isinstance(k1, Column) else k1, F.lit(b) if not isinstance(b, Column) else b
    return tf / (tf + k1 * (F.lit(1.0) - b + b * dl / avgdl))


def _tf_part(k1: float, b: float, avgdl: float):
    """``bm25_tf_part`` on numpy arrays."""
    return lambda tf, dl: tf / (tf + k1 * (1.0 - b + b * dl / avgdl))


@dataclass
class BM25Parts:
    """Shared pieces of BM25 over one corpus and one topic set.

    terms: (docid, dl, term, tf) of the query vocabulary, lazily; qw: (qid, term, qw) with
    qw = qtf * idf; n_docs / avgdl.  hits: the terms by document instead, if there are any
    and the topics are few enough.
    """

    terms: DataFrame
    qw: DataFrame
    n_docs: int
    avgdl: float
    qterm_bound: int
    hits: DocHits | None = None


def bm25_parts(docs: DataFrame, topics: DataFrame, text_col: str = "text",
               query_col: str = "query", qterm_bound: int | None = None, hits: DocHits | None = None) -> BM25Parts:
    """One scan gives df of the query terms and, from a marker that every document has,
    N and avgdl; the table (at most one row per vocabulary term) is written once.  With
    ``hits`` of the whole corpus and a vocabulary that holds the topics', no text is read."""
    if qterm_bound is None:
        qterm_bound = query_term_bound(topics, query_col)
    qt = query_terms(topics, query_col)
    vocab = qt.select("term").distinct()
    marked = vocab.unionByName(qt.sparkSession.range(1).select(F.lit(DOC_MARK).alias("term")))
    if hits is not None:
        number = F.explode_outer(F.concat(F.array(F.lit(-1)), "terms")).alias("_n")
        seen = hits.rows.select("dl", number).groupBy("_n").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl"))
        names = qt.sparkSession.createDataFrame([(-1, DOC_MARK), *enumerate(hits.vocab)], "_n int, term string")
        stats = checkpoint(seen.join(F.broadcast(names), "_n").select("term", "df", "dl"))
    else:
        tokens = docs.select(all_tokens(text_col).alias("_t"))
        seen = tokens.select(F.size("_t").alias("dl"),
                             F.explode_outer(F.concat(F.array(F.lit(DOC_MARK)), F.array_distinct("_t"))).alias("term"))
        stats = checkpoint(seen.join(broadcast_bounded(marked, qterm_bound + 1), "term", "left_semi")
                           .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl")))
    total = stats.filter(F.col("term") == DOC_MARK).first()
    n_docs, avgdl = (total.df, total.dl / total.df) if total else (0, 0.0)
    qw = (qt.join(broadcast_bounded(stats.filter(F.col("term") != DOC_MARK), qterm_bound), "term")
          .select("qid", "term", (F.col("qtf") * idf(F.lit(n_docs), F.col("df"))).alias("qw")))
    if hits is None and small(qterm_bound):
        hits = doc_hits(docs, vocabulary(vocab), text_col)
    return BM25Parts(vocabulary_hits(docs, vocab, qterm_bound, text_col), qw, n_docs, avgdl, qterm_bound, hits)


def bm25_hits(parts: BM25Parts) -> DataFrame:
    """(qid, docid, dl, tf, qw) for every (query term, document) hit."""
    return (parts.terms.join(broadcast_bounded(parts.qw, parts.qterm_bound), "term")
            .select("qid", "docid", "dl", "tf", "qw"))


def bm25(docs: DataFrame | None, topics: DataFrame | None, k1: float = BM25_K1, b: float = BM25_B,
         k: int | None = SEARCH_DEPTH, text_col: str = "text", query_col: str = "query",
         qterm_bound: int | None = None, parts: BM25Parts | None = None) -> DataFrame:
    """R2 + R3: BM25 run (qid, docid, score, rank), best k per query."""
    parts = parts or bm25_parts(docs, topics, text_col, query_col, qterm_bound)
    if parts.hits is not None:
        run = weighted_sums(parts.hits, parts.qw, "qid", "qw", [_tf_part(k1, b, parts.avgdl)], k)
        return rank_within(run.select("qid", "docid", "score"), ("qid",), "score", k=k)
    run = (bm25_hits(parts).select(
        "qid", "docid", (F.col("qw") * bm25_tf_part(F.col("tf"), F.col("dl"), F.lit(parts.avgdl), k1, b)).alias("w"))
        .groupBy("qid", "docid").agg(F.sum("w").alias("score")))
    return rank_within(run, ("qid",), "score", k=k)


def bm25_sweep(docs: DataFrame, topics: DataFrame, grid: Sequence[tuple[float, float]],
               k: int | None = SEARCH_DEPTH, text_col: str = "text", query_col: str = "query",
               qterm_bound: int | None = None, parts: BM25Parts | None = None) -> DataFrame:
    """One BM25 run per (k1, b).

    Every grid point is summed in the same pass over a document's terms (as a column of the
    (query, document) row that is exploded after it, if the topics are too many to broadcast),
    so the grid multiplies no shuffled row before the top-k.
    """
    parts = parts or bm25_parts(docs, topics, text_col, query_col, qterm_bound)
    names = [f"bm25_k1={k1:.2f}_b={b:.2f}" for k1, b in grid]
    if parts.hits is not None:
        run = weighted_sums(parts.hits, parts.qw, "qid", "qw", [_tf_part(k1, b, parts.avgdl) for k1, b in grid], k)
        run = run.select(F.get(F.array(*map(F.lit, names)), F.col("part")).alias("run_id"), "qid", "docid", "score")
        return rank_within(run, ("run_id", "qid"), "score", k=k)
    avgdl = F.lit(parts.avgdl)
    sums = [F.sum(F.col("qw") * bm25_tf_part(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias(f"s{i}")
            for i, (k1, b) in enumerate(grid)]
    points = F.array(*[F.struct(F.lit(name).alias("run_id"), F.col(f"s{i}").alias("score"))
                       for i, name in enumerate(names)])
    run = (bm25_hits(parts).groupBy("qid", "docid").agg(*sums)
           .select("qid", "docid", F.explode(points).alias("p")).select("p.run_id", "qid", "docid", "p.score"))
    return rank_within(run, ("run_id", "qid"), "score", k=k)


def best_run_per_fold(fold_means: DataFrame, metric: str = "ndcg_cut_20",
                      split: str = "dev") -> DataFrame:
    """Per fold, the run with the best mean ``metric`` on ``split``.

    ``fold_means`` is (run_id, fold, split, metric, value) from
    ``metrics.mean_metrics``; values are compared after rounding to ``MEAN_DIGITS``, so
    that equal runs tie whatever the order of summation; ties go to the smaller run_id.
    """
    cand = fold_means.filter((F.col("split") == split) & (F.col("metric") == metric))
    w = Window.partitionBy("fold").orderBy(F.round("value", MEAN_DIGITS).desc(), F.col("run_id").asc())
    return (cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("fold", "run_id", "metric", "value"))
