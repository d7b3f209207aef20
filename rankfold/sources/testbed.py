"""Benchmark inputs derived from the driver's tables (corpus, topics, qrels, folds).

The reference reads a trec-web corpus, topic files, qrels and fold JSON; the test
data has ``documents`` and ``benchmark`` instead.  These functions derive the
same shapes with Spark so that every query's work grows with the given tables.

* docs    (docid string, doc_id long, text)           docid = doc_id as string
* topics  (qid string, item_id long, query_type, query) desc = whole text,
          title = all its tokens, joined by spaces
* qrels   (qid, docid, rel)  r = share of the topic's distinct desc terms found
          in the document: rel 2 if r >= .95, 1 if .4 <= r < .95,
          0 if .2 <= r < .4, else unjudged
* folds   (fold, split, qid) test bucket item_id % n + 1; dev of s_i is the test
          set of s_{i-1} (s1 takes the last); the rest is train
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import explode_terms, tokenize
from ..operators.benchmark import make_folds
from ..operators.hits import DocHits, doc_hits, small, vocabulary, weighted_sums
from ..operators.sizing import broadcast_bounded, row_bound

# Fixed values of the derivation.
QREL_CUTS = (0.95, 0.4, 0.2)  # rel 2, rel 1, rel 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("docid"), "doc_id", "text")


def topics(spark: SparkSession, sf_dir: str, query_type: str | None = None) -> DataFrame:
    """B10 input: both query types; pass ``query_type`` to keep one."""
    b = table(spark, sf_dir, "benchmark")
    t = b.select(
        F.col("item_id").cast("string").alias("qid"), "item_id",
        F.explode(F.array(
            F.struct(F.lit("title").alias("query_type"),
                     F.array_join(tokenize("text"), " ").alias("query")),
            F.struct(F.lit("desc").alias("query_type"), F.col("text").alias("query")),
        )).alias("t"),
    ).select("qid", "item_id", "t.query_type", "t.query")
    if query_type is not None:
        t = t.filter(F.col("query_type") == query_type)
    return t


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, term): the distinct desc terms of every topic; its title has the same."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))


def topic_terms_bound(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``topic_terms``."""
    b = table(spark, sf_dir, "benchmark")
    return int(b.select(F.sum(F.size(F.array_distinct(tokenize("text"))))).first()[0] or 0)


def qrels(spark: SparkSession, sf_dir: str, hits: DocHits | None = None) -> DataFrame:
    """Judgments from term overlap; no nested loop.

    The topic side (distinct desc terms of every topic) is bounded by the topic table and is
    broadcast behind that bound; a document's hits are summed per topic in its own task, from
    ``hits`` (all topic terms) if they are given.  Beyond the bound document terms are joined
    with the topics' and counted by (document, topic).
    """
    n_topics = row_bound(table(spark, sf_dir, "benchmark"))
    tterms = topic_terms(spark, sf_dir)
    tsize = tterms.groupBy("item_id").agg(F.count(F.lit(1)).alias("nt"))
    bound = topic_terms_bound(spark, sf_dir)
    if hits is None and small(bound):
        hits = doc_hits(docs(spark, sf_dir), vocabulary(tterms))
    if hits is not None:
        # a distinct term of one of a document's rows counts once
        weights = tterms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
        one = hits.with_rows(lambda rows: rows.withColumns({"tfs": F.transform("terms", lambda t: F.lit(1)), "dl": F.lit(0)}))
        counted = (weighted_sums(one, weights, "item_id", "times", [lambda tf, dl: tf], share=QREL_CUTS[-1])
                   .select("docid", "item_id", F.col("score").alias("nh")))
    else:
        d = table(spark, sf_dir, "documents")
        dterms = explode_terms(d, "doc_id", tokens=F.array_distinct(tokenize("text")))
        counted = (dterms.join(broadcast_bounded(tterms, bound), "term")
                   .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("nh"))
                   .select(F.col("doc_id").cast("string").alias("docid"), "item_id", "nh"))
    r = F.col("nh") / F.col("nt")
    hi, mid, lo = QREL_CUTS
    rel = F.when(r >= hi, 2).when(r >= mid, 1).when(r >= lo, 0)
    return (counted.join(broadcast_bounded(tsize, n_topics), "item_id")
            .select(F.col("item_id").cast("string").alias("qid"), "docid", rel.alias("rel"))
            .filter(F.col("rel").isNotNull()))


def folds(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """B1 on the benchmark topics: (fold, split, qid), one row per fold per topic."""
    b = table(spark, sf_dir, "benchmark")
    return make_folds(b.select(F.col("item_id").cast("string").alias("qid"),
                               F.col("item_id").alias("ord")), n)
