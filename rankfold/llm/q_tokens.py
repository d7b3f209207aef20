"""Queries of the token operators (1, 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import bpe, token_files

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, vocabulary_path(), end_id=END_ID)
    return token_files.read_documents(spark, path, ids=False)


QUERIES = {"op1_bpe": op1_bpe, "op2_token_files": op2_token_files}
ORACLE: dict[str, str] = {}
