"""Registered queries of the package: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_near, q_select, q_text, q_tokens, q_vectors, q_words

QueryFn = Callable[[SparkSession, str], DataFrame]
MODULES = (q_tokens, q_select, q_text, q_vectors, q_near, q_words)


def queries() -> dict[str, QueryFn]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
