"""The stream of training samples (K3 with replacement): sample number -> triplet.

A trainer takes ``NITERS`` x ``ITERSIZE`` x ``BATCH`` triplets of a fold.  Sample s of a
fold takes three numbers from one md5 of (seed, fold, s): a query among those with both
positives and negatives, one of its positives and one of its negatives.  Nothing is kept
from sample to sample, so any range can be made alone, by any task, always the same.

Positives and negatives of a fold are numbered through, query by query; a query's first
number is the prefix sum of the counts before it.  A sample's documents are then looked up
by two equi-joins on (fold, number), whose keys are spread evenly: no query, however deep
its run, is one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sample_order
from ..session import checkpoint
from .ordering import sequence_number
from .rerank import pred_pairs
from .sizing import broadcast_bounded, row_bound
from .trainlog import ITERSIZE, NITERS

# Fixed value of the reference trainer config.
BATCH = 16
SAMPLES = NITERS * ITERSIZE * BATCH


@dataclass
class SampleSource:
    """queries: (fold, q, qid, n_queries, n_pos, n_neg, first_pos, first_neg), q from 0;
    pos, neg: (fold, number, docid), number from 0 within the fold."""

    queries: DataFrame
    pos: DataFrame
    neg: DataFrame
    seed: int


def sample_source(run: DataFrame, qrels: DataFrame, level: int = 1, seed: int = 42) -> SampleSource:
    """Number the training documents of ``run`` (fold, qid, docid); a document judged at
    ``level`` or above is a positive, any other a negative.  Queries without either take
    no part."""
    labelled = checkpoint(pred_pairs(run.select("fold", "qid", "docid"), qrels)
                          .select("fold", "qid", "docid", F.coalesce(F.col("rel") >= level, F.lit(False)).alias("is_pos")))
    counts = labelled.groupBy("fold", "qid").agg(F.count(F.when(F.col("is_pos"), 1)).alias("n_pos"),
                                                 F.count(F.when(~F.col("is_pos"), 1)).alias("n_neg"))
    # one row per query and fold: bounded by the topic set
    by = Window.partitionBy("fold").orderBy("qid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    queries = checkpoint(counts.filter("n_pos > 0 and n_neg > 0").select(
        "fold", (F.row_number().over(by) - 1).cast("long").alias("q"), "qid",
        F.count(F.lit(1)).over(Window.partitionBy("fold")).alias("n_queries"), "n_pos", "n_neg",
        F.coalesce(F.sum("n_pos").over(before), F.lit(0)).alias("first_pos"),
        F.coalesce(F.sum("n_neg").over(before), F.lit(0)).alias("first_neg")))
    small = broadcast_bounded(queries.select("fold", "qid", "q"), row_bound(queries))
    mine = labelled.join(small, ["fold", "qid"])

    def numbered(side: Column) -> DataFrame:
        docs = mine.filter(side).select("fold", "q", "docid", sample_order(seed, "qid", "docid").alias("o"))
        return (sequence_number(docs, ["fold"], ["q", "o", "docid"], "number")
                .select("fold", (F.col("number") - 1).alias("number"), "docid"))

    return SampleSource(queries, checkpoint(numbered(F.col("is_pos"))), checkpoint(numbered(~F.col("is_pos"))), seed)


def sample_stream(spark: SparkSession, source: SampleSource, start: int = 0, end: int = SAMPLES) -> DataFrame:
    """(fold, sample, qid, pos_docid, neg_docid) of the samples start..end-1 of every fold."""
    folds = source.queries.select("fold").distinct()
    n_folds = row_bound(folds)
    if not n_folds or end <= start:
        return spark.createDataFrame([], "fold string, sample long, qid string, pos_docid string, neg_docid string")
    names = [r.fold for r in folds.collect()]
    h = sample_order(source.seed, "fold", "sample")
    part = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    drawn = (spark.range(start, end).select(F.col("id").alias("sample"), F.explode(F.array(*map(F.lit, names))).alias("fold"))
             .withColumn("h", h).select("fold", "sample", *[part(i).alias(f"u{i}") for i in range(3)]))
    sizes = source.queries.select("fold", "n_queries").distinct()
    picked = (drawn.join(broadcast_bounded(sizes, n_folds), "fold")
              .withColumn("q", F.col("u0") % F.col("n_queries")).drop("n_queries")
              .join(broadcast_bounded(source.queries.drop("n_queries"), row_bound(source.queries)), ["fold", "q"])
              .select("fold", "sample", "qid", (F.col("first_pos") + F.col("u1") % F.col("n_pos")).alias("pos"),
                      (F.col("first_neg") + F.col("u2") % F.col("n_neg")).alias("neg")))
    return (picked.join(source.pos.select("fold", F.col("number").alias("pos"), F.col("docid").alias("pos_docid")), ["fold", "pos"])
            .join(source.neg.select("fold", F.col("number").alias("neg"), F.col("docid").alias("neg_docid")), ["fold", "neg"])
            .select("fold", "sample", "qid", "pos_docid", "neg_docid"))
