"""Query of the nearest-neighbour operator (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann

# Fixed value: every row whose id is divisible by this is a query.
QUERY_STEP = 50


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0).select("vec_id"))


QUERIES = {"op9_ann": op9_ann}
ORACLE: dict[str, str] = {}
