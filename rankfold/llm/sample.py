"""Bounded training samples, chosen by a hash of the id: the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 2 ** 31


def unit_hash(*cols: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(_STEPS)) / F.lit(float(_STEPS))


def about(df: DataFrame, id_col: str, n_rows: int, seed: int = 42) -> DataFrame:
    """About ``n_rows`` rows (all, if there are fewer), in expectation; no shuffle."""
    total = df.count()
    return df.filter(unit_hash(id_col, seed=seed) < F.lit(n_rows / max(total, n_rows)))
