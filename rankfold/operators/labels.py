"""The judgments that a run needs.

Judgments grow with the corpus, a run is bounded by its topics and depth: the run's pairs are
written, counted and broadcast onto the judgments, so that these are read where they lie and
only the few of the run's documents go on to joins and windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import checkpoint
from .sizing import broadcast_bounded, row_bound


def labels_of(run: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("qid", "docid")) -> DataFrame:
    """The rows of ``qrels`` whose keys a row of ``run`` has."""
    pairs = checkpoint(run.select(*keys).distinct())
    return qrels.join(broadcast_bounded(pairs, row_bound(pairs)), list(keys), "left_semi")
