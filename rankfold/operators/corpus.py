"""Corpus statistics and document lookup.

Per-term sums are pre-aggregated per task, so a hot term (a stop word in most documents)
does not skew.  Postings come in two ways: of all terms, counted inside a document's row
and not shuffled here (``doc_terms``, for an index), or of a small vocabulary, cut to it
where the document is read and counted after a shuffle by document (``vocabulary_hits``;
``hits.doc_hits`` counts before it, if the vocabulary can be broadcast).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from .sizing import broadcast_bounded


def with_tokens(docs: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Add the token array of the whole text."""
    return docs.withColumn(out, tokenize(text_col))


def all_tokens(text_col: str = "text") -> Column:
    """Tokens of a text; a null text has none."""
    return F.coalesce(tokenize(text_col), F.array().cast("array<string>"))


COUNT_SLICE = 256  # documents whose tokens are counted at once
DOC_MARK = ""  # a term that every document has once (tokens are never empty)


def doc_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(docid, dl, term, tf): one row per distinct term of every document, counted inside
    the row, so nothing is shuffled.

    The text is tokenized by Spark; a slice's tokens are counted as an Arrow batch."""
    tokens = docs.select("docid", all_tokens(text_col).alias("_t"))
    schema = T.StructType([tokens.schema["docid"], T.StructField("dl", T.IntegerType()),
                           T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_SLICE):
                b = batch.slice(at, COUNT_SLICE)
                dl = pc.cast(pc.list_value_length(b.column(1)), pa.int32())
                coded = b.column(1).flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(b.num_rows), dl) * size + coded.indices.to_numpy(), return_counts=True)
                row = pa.array(key // size)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), dl.take(row), coded.dictionary.take(pa.array(key % size)), pa.array(tf.astype(np.int64))],
                    names=["docid", "dl", "term", "tf"])

    return tokens.mapInArrow(run, schema)


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_which, term): one row per token (0) and one per distinct term (1) of every document,
    from one tokenization."""
    tokens = docs.select(all_tokens(text_col).alias("_t")).select(F.array("_t", F.array_distinct("_t")).alias("_both"))
    which = tokens.select(F.posexplode_outer("_both").alias("_which", "_terms"))
    return which.select("_which", F.explode_outer("_terms").alias("term")).filter(F.col("term").isNotNull())


def vocabulary_hits(docs: DataFrame, vocab: DataFrame, vocab_bound: int | None, text_col: str = "text") -> DataFrame:
    """(docid, dl, term, tf) of the terms in ``vocab`` (column term, distinct).

    Tokens outside the vocabulary go where the text is read; the others are shuffled by
    document, once, and counted there."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = docs.select("docid", all_tokens(text_col).alias("_t"))
    one = tokens.select("docid", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
    return (one.join(broadcast_bounded(vocab, vocab_bound), "term", "left_semi").repartition(n, "docid")
            .groupBy("docid", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


@dataclass
class TermStats:
    """Postings (docid, dl, term, tf), terms (term, df, cf), doc_len (docid, dl)
    and the collection constants N and avgdl as scalar-subquery columns."""

    postings: DataFrame
    terms: DataFrame
    doc_len: DataFrame
    n_docs: Column
    avgdl: Column


def term_stats(docs: DataFrame, text_col: str = "text") -> TermStats:
    """Only per-term partial sums are shuffled: tokens are counted where they are read."""
    doc_len = docs.select("docid", F.size(tokenize(text_col)).alias("dl"))
    postings = doc_terms(docs, text_col)
    terms = term_counts(docs, text_col).groupBy("term").agg(
        F.count(F.when(F.col("_which") == 1, 1)).alias("df"), F.count(F.when(F.col("_which") == 0, 1)).alias("cf"))
    coll = doc_len.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return TermStats(postings, terms, doc_len,
                     coll.select("n").scalar(), coll.select("avgdl").scalar())


def run_docids(run: DataFrame) -> DataFrame:
    """L1: distinct document ids a run needs."""
    return run.select("docid").distinct()


def fetch_docs(docs: DataFrame, ids: DataFrame, ids_bound: int | None = None) -> DataFrame:
    """L2: only the documents whose id is asked for (left-semi join).

    ``ids_bound`` is a proven upper bound of the id set (e.g. topics x depth);
    below the broadcast limit the corpus is filtered map-side without a shuffle.
    """
    return docs.join(broadcast_bounded(ids.select("docid"), ids_bound), "docid", "left_semi")


def missing_docs(docs: DataFrame, ids: DataFrame, ids_bound: int | None = None) -> DataFrame:
    """L2 check: asked ids that the corpus does not have.

    The corpus is cut to the asked ids first (map-side below the bound), so only small
    sides meet in the anti join."""
    asked = ids.select("docid").distinct()
    found = fetch_docs(docs.select("docid"), asked, ids_bound)
    return asked.join(found.distinct(), "docid", "left_anti")
