"""Training-data pipeline over ``documents``: five stages of the operators in ``rankfold.llm``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents it keeps, which are written as Parquet and read again for the next one.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import bpe, exact_dedup, langid, mix, near_dup, q_tokens
from rankfold.session import scratch_dir

ORACLE_SQL = None  # models, signatures and encodings: tested against brute force instead


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a letter go, and those whose language is much less sure
    than that of any held-out document of it (``langid.cutoffs``).  Without a model, for want
    of labels, every document with a letter stays."""
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = F.lit(0.0)
    for lang, cut in langid.cutoffs(docs, model).items():
        least = F.when(F.col("_language") == lang, cut).otherwise(least)
    found = langid.predict(docs, model, pred="_language", score="_score")
    sure = (F.col("_language") != langid.UNDETERMINED) & (F.col("_score") >= least)
    return found.filter(sure).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of equal texts stays."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near copies stays."""
    return near_dup.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in the order of the mix; one taken k times is k rows."""
    return mix.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids of every whole text (what they decode to is the text)."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), q_tokens.vocabulary_path())
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
