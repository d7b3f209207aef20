"""Fits and cuts that read all rows, not a sample."""

import pytest
from pyspark.sql import functions as F

from rankfold.llm import langid, pii
from rankfold.llm.sample import unit_hash


def test_pii_learns_from_all_documents(spark):
    """Base spans only in documents that a sample of 20,000 of 40,000 leaves out."""
    far = unit_hash("doc_id") > 0.6
    df = spark.range(40_000).select(F.col("id").alias("doc_id")).withColumn(
        "text", F.when(far & (F.col("doc_id") % 40 < 2), F.concat(F.lit("mail a"), "doc_id", F.lit("@ex.com"))).otherwise(
            F.when(F.col("doc_id") % 40 == 5, F.concat(F.lit("no "), F.col("doc_id") + 1234567)).otherwise("x")))
    assert pii.fit(df) is not None


def test_language_cut_reads_all_held_out_documents(spark):
    class ByLength:
        langs = ["xx"]

        def texts(self, texts):
            import numpy as np
            return np.array([[0.5 if len(t) > 20 else 0.9] for t in texts])

    ids = spark.range(12_000).select(F.col("id").alias("doc_id"))
    held = ids.filter(langid.held_out(F.col("doc_id")))
    low = held.filter(unit_hash("doc_id", seed=langid.SEED + 1) > 0.7).first().doc_id  # outside 1,500 of some 3,000
    df = ids.select("doc_id", F.when(F.col("doc_id") == low, "a text of more than twenty letters").otherwise("short").alias("text"),
                    F.lit("xx").alias("lang"))
    assert langid.cutoffs(df, ByLength()) == {"xx": pytest.approx(langid.CUT_SHARE * 0.5)}
