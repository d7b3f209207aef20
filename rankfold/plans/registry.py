"""Query registry shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .context import Experiment

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


# Outputs are rounded to 6 digits after a 1e-9 nudge: means of metrics are often
# exact decimal ties (x.xxxxxx5) and float noise from summation order would
# otherwise round them up in one engine and down in another.
NUDGE = 1e-9


def r6(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), 6)


def X(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Experiment:
    """The standard experiment; ``materialize=False`` for queries that read each
    shared intermediate only once (no checkpoint needed)."""
    return Experiment(spark, sf_dir, materialize)
