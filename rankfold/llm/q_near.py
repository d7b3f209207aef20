"""Query of the near-duplicate operator (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import near_dup
from .q_tokens import documents


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir)).drop("h")


QUERIES = {"op3_neardup": op3_neardup}
ORACLE: dict[str, str] = {}
