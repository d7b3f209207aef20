"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

Each query reads the whole driver tables (or data Spark derives from them).
Floating outputs are rounded to 6 digits, matching the oracle SQL.
"""

from __future__ import annotations

from . import q_bench, q_core, q_crossval, q_index, q_io, q_rerank, q_text, q_trainlog  # noqa: F401  (registers)
from .registry import ORACLE, QUERIES, QueryFn


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
