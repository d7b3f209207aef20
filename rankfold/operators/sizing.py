"""Broadcast only behind a size check.

A side is broadcast when a bound of its bytes, *proven* from a cheap input (the topic
set, a parameter grid: rows times the width of a row), is under ``BROADCAST_MAX_BYTES``;
otherwise the join is left to Spark (sort-merge join, AQE may still switch at runtime
from measured sizes, and AQE skew-join splits hot keys).  Corpus-sized tables (postings,
runs, passages) are never hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 64 << 20
# Assumed bytes of a string, and elements of an array whose length the caller does not give.
STRING_BYTES = 48
ARRAY_ITEMS = 64


def row_bytes(kind: T.DataType, array_items: int = ARRAY_ITEMS) -> int:
    """Assumed bytes of one value of a type."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_bytes(f.dataType, array_items) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 + array_items * row_bytes(kind.elementType, array_items)
    return STRING_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def broadcast_bounded(df: DataFrame, bound_rows: int | None, max_bytes: int = BROADCAST_MAX_BYTES,
                      array_items: int = ARRAY_ITEMS) -> DataFrame:
    """Hint ``broadcast`` iff ``bound_rows`` (an upper bound of ``df``'s rows) is known and
    that many rows are small; ``array_items`` bounds the elements of its arrays."""
    if bound_rows is not None and bound_rows * row_bytes(df.schema, array_items) <= max_bytes:
        return F.broadcast(df)
    return df


def row_bound(df: DataFrame) -> int:
    """Exact row count of a *small source* table (topics, folds, grids).

    Only call this on inputs whose scan is cheap; it is the check that makes
    the broadcast of tables derived from them safe.
    """
    return int(df.count())
