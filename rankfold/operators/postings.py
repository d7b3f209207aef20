"""Postings kept by term (R1) and retrieval from them.

``write_index`` scans the corpus once and leaves three Parquet tables in a folder:

    postings    (term, docid, dl, tf) in folders of ``bucket`` (a hash of the term), each
                sorted by (term, docid)
    terms       (term, df, cf, max_tf, min_dl, max_part) in the same buckets
    collection  one row: n_docs, total_dl, buckets, k1, b

A document's terms are counted inside its row; the only large shuffle is the range sort
by (bucket, term, docid), which cuts a hot term (a stop word in most documents) into many
tasks and files.  A search touches the buckets of its own terms only: their numbers are a
filter on the folders, the query side is broadcast onto the postings, and nothing is
shuffled by term.  The corpus is not read again.

``safe_top_k`` finds the k best documents without scoring all hits.  A term's greatest
possible weight in a document is known (``max_part``), so the terms of a query fall into

    1. the leading ones, of the greatest bounds, until they hold ``FIRST_HITS`` * k hits:
       the k-th best sum of these is a floor of the k-th score;
    2. the essential ones: all whose later bounds together reach the floor.  A document
       with none of them stays below the floor and cannot be among the best;
    3. the others: added only for documents whose sum so far plus the others' bounds
       reaches the floor.

Every document among the k best gets its whole score, so the rows are those of the full
scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .corpus import all_tokens, doc_terms
from .hits import DocHits, small, vocabulary
from .retrieve import BM25_B, BM25_K1, SEARCH_DEPTH, BM25Parts, bm25_tf_part, idf, query_terms, query_term_bound, rank_within
from .sizing import broadcast_bounded, row_bound

SCHEMAS = {
    "postings": "term string, docid string, dl int, tf long, bucket int",
    "terms": "term string, df long, cf long, max_tf long, min_dl int, max_part double, bucket int",
}
BUCKETS = 64
FIRST_HITS = 4
# Scores are compared after rounding to 6 digits; a bound must be below the floor by more.
SLACK = 2e-6


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


# -- building ---------------------------------------------------------------------------------
def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS, text_col: str = "text",
                k1: float = BM25_K1, b: float = BM25_B) -> None:
    """Write the index of (docid, text) to ``path``; choose ``buckets`` so that one holds
    some 100 MB.  ``max_part`` (the greatest tf part of a term in any document) is kept
    for the given k1 and b; for others it is bounded by max_tf and min_dl.

    Documents without tokens count in the collection and have no postings; ids are
    unique."""
    spark = docs.sparkSession
    n = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # (written first: a range sort reads its input twice, which would tokenize it twice)
    counted = checkpoint(doc_terms(docs, text_col))
    (counted.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "docid", "dl", "tf")
     .repartitionByRange(n, "bucket", "term", "docid").sortWithinPartitions("bucket", "term", "docid")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    (docs.select(F.size(all_tokens(text_col)).alias("dl"))
     .agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"))
     .withColumns({"buckets": F.lit(buckets), "k1": F.lit(float(k1)), "b": F.lit(float(b))})
     .coalesce(1).write.parquet(f"{path}/collection"))
    c = spark.read.parquet(f"{path}/collection").first()
    part = bm25_tf_part(F.col("tf"), F.col("dl"), F.lit(c.total_dl / max(1, c.n_docs)), k1, b)
    (spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings").groupBy("bucket", "term")
     .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
          F.max(part).alias("max_part"))
     .repartitionByRange(min(n, buckets), "bucket").sortWithinPartitions("bucket", "term")
     .write.partitionBy("bucket").parquet(f"{path}/terms"))


# -- reading ------------------------------------------------------------------------------------
@dataclass
class Index:
    spark: SparkSession
    path: str
    n_docs: int
    avgdl: float
    buckets: int
    k1: float
    b: float

    def table(self, name: str, asked: list[int] | None = None) -> DataFrame:
        """A table of the index, of the asked buckets only (a filter on its folders)."""
        t = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return t if asked is None else t.filter(F.col("bucket").isin(asked))

    def lists(self, terms: DataFrame, bound: int | None, name: str = "postings", keep: tuple[str, ...] = ()) -> DataFrame:
        """The rows of a table for ``terms`` (term, <keep>..).

        The buckets' numbers (at most ``buckets``) come to the driver; the terms are
        broadcast behind their bound."""
        mine = terms.select("term", *keep, bucket_of(F.col("term"), self.buckets).alias("bucket"))
        asked = sorted(r.bucket for r in mine.select("bucket").distinct().collect())
        return self.table(name, asked).join(broadcast_bounded(mine, bound), ["bucket", "term"]).drop("bucket")


def read_index(spark: SparkSession, path: str) -> Index:
    c = spark.read.parquet(f"{path}/collection").first()
    return Index(spark, path, c.n_docs, c.total_dl / max(1, c.n_docs), c.buckets, c.k1, c.b)


def weighted_terms(index: Index, topics: DataFrame, k1: float, b: float, query_col: str = "query",
                   bound: int | None = None) -> DataFrame:
    """(qid, term, qw, df, top): BM25 weights of the query terms that the index knows, and
    the most that a term can add to a score."""
    qt = query_terms(topics, query_col)
    known = index.lists(qt.select("term").distinct(), bound, "terms")
    part = F.col("max_part") if (k1, b) == (index.k1, index.b) else bm25_tf_part(
        F.col("max_tf"), F.col("min_dl"), F.lit(index.avgdl), k1, b)
    qw = F.col("qtf") * idf(F.lit(index.n_docs), F.col("df"))
    return (qt.join(broadcast_bounded(known, bound), "term")
            .select("qid", "term", qw.alias("qw"), "df", (qw * part).alias("top")))


def index_parts(index: Index, topics: DataFrame, query_col: str = "query", qterm_bound: int | None = None) -> BM25Parts:
    """The pieces of BM25 from the index, for ``bm25`` and ``bm25_sweep``: the postings of
    the query terms and their weights, with no scan of the corpus."""
    if qterm_bound is None:
        qterm_bound = query_term_bound(topics, query_col)
    qw = checkpoint(weighted_terms(index, topics, index.k1, index.b, query_col, qterm_bound).select("qid", "term", "qw"))
    terms = index.lists(qw.select("term").distinct(), qterm_bound)
    hits = None
    if small(qterm_bound):
        vocab = vocabulary(qw)
        numbers = index.spark.createDataFrame(list(enumerate(vocab)), "_n int, term string")
        lists = index.lists(numbers, qterm_bound, keep=("_n",))
        found = lists.groupBy("docid", "dl").agg(F.collect_list(F.struct("_n", F.col("tf").cast("int").alias("tf"))).alias("_h"))
        rows = checkpoint(found.select("docid", "dl", F.col("_h._n").alias("terms"), F.col("_h.tf").alias("tfs")))
        hits = DocHits(rows, vocab, True)
    return BM25Parts(terms, qw, index.n_docs, index.avgdl, qterm_bound, hits)


# -- the k best without all hits -------------------------------------------------------------------
@dataclass
class SafeTopK:
    """run: (qid, docid, score, rank); hits: (qid, hits, scored): the postings of a query's
    terms, and those of them that were added to some score."""

    run: DataFrame
    hits: DataFrame


def _floors(sums: DataFrame, k: int) -> DataFrame:
    """(qid, floor): the k-th best sum of each query that has k documents."""
    best = rank_within(sums.select("qid", "docid", "score"), ("qid",), "score", k=k, digits=None)
    return best.filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))


def safe_top_k(index: Index, topics: DataFrame, k: int = SEARCH_DEPTH, k1: float = BM25_K1, b: float = BM25_B,
               query_col: str = "query", qterm_bound: int | None = None, first_hits: int = FIRST_HITS) -> SafeTopK:
    """The k best documents of every query, equal to ``bm25(.., k=k)`` (see the module).

    Sums of a pass are written once; they hold one row for every document that a query's
    essential terms reach.  Windows over terms hold one query's terms each."""
    if qterm_bound is None:
        qterm_bound = query_term_bound(topics, query_col)
    n_queries = row_bound(topics)
    weights = checkpoint(weighted_terms(index, topics, k1, b, query_col, qterm_bound))

    def hits(terms: DataFrame) -> DataFrame:
        part = bm25_tf_part(F.col("tf"), F.col("dl"), F.lit(index.avgdl), k1, b)
        lists = index.lists(terms.select("term", "qid", "qw"), qterm_bound, keep=("qid", "qw"))
        return lists.select("qid", "docid", (F.col("qw") * part).alias("score"), F.lit(1).alias("scored"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("qid", "docid").agg(F.sum("score").alias("score"), F.sum("scored").cast("int").alias("scored"))

    # 1. leading terms and the first floor
    by_top = Window.partitionBy("qid").orderBy(F.col("top").desc(), "term")
    before = F.coalesce(F.sum("df").over(by_top.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("top").over(by_top.rowsBetween(0, Window.unboundedFollowing))
    ordered = checkpoint(weights.withColumn("leading", before < first_hits * k).withColumn("later", later))
    first = checkpoint(summed(hits(ordered.filter("leading"))))

    def parted(floors: DataFrame) -> DataFrame:
        """The terms, and whether each is essential: with it and all later ones a document
        can still reach the floor."""
        t = ordered.join(broadcast_bounded(floors, n_queries), "qid", "left")
        return t.withColumn("essential", F.col("leading") | F.col("floor").isNull() | (F.col("later") >= F.col("floor") - SLACK))

    # 2. all essential terms, and the better floor
    terms = checkpoint(parted(_floors(first, k)))
    sums = checkpoint(summed(first.union(hits(terms.filter("essential and not leading")))))
    floors = checkpoint(_floors(sums, k))
    # 3. the others, for documents that can still reach it
    others = terms.filter("not essential").select("qid", "term", "qw", "top")
    rest = others.groupBy("qid").agg(F.sum("top").alias("rest"))
    limits = floors.join(rest, "qid", "full").select("qid", (F.coalesce("floor", F.lit(float("-inf")))
                                                             - F.coalesce("rest", F.lit(0.0)) - SLACK).alias("least"))
    alive = checkpoint(sums.join(broadcast_bounded(limits, n_queries), "qid", "left")
                       .filter(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least"))
    added = hits(others).join(broadcast_bounded(alive.select("qid", "docid"), row_bound(alive)), ["qid", "docid"], "left_semi")
    whole = summed(alive.union(added))
    # counted: all hits of passes 1 and 2, and those added in 3
    more = summed(added).groupBy("qid").agg(F.sum("scored").alias("more"))
    counted = (terms.groupBy("qid").agg(F.sum("df").alias("hits"), F.sum(F.when(F.col("essential"), F.col("df"))).alias("sure"))
               .join(broadcast_bounded(more, n_queries), "qid", "left")
               .select("qid", "hits", (F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("scored")))
    return SafeTopK(rank_within(whole.drop("scored"), ("qid",), "score", k=k), counted)
