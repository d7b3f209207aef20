"""Training-log analytics (G1-G4): epoch roll-up, validation points, best epoch,
metric selection.  Log tables, not the trainer.

* train_log (run_id, step, loss)           one row per optimisation step
* dev_log   (run_id, epoch, metric, value) validation metrics per epoch
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import DEFAULT_METRICS
from .ordering import sequence_number

# Fixed values of the reference trainer config.
ITERSIZE = 256
NITERS = 36
VALIDATE_FREQ = 4
DEV_PREFIX = "dev-"


def train_log_from_events(events: DataFrame) -> DataFrame:
    """Stand-in log: run_id = event_type, loss = value, step = position by (ts, event_id).

    Steps are numbered with a range-partitioned sort, so a run holding a large
    share of the log is never sorted in one task.
    """
    e = events.select(F.col("event_type").alias("run_id"), "ts", "event_id", F.col("value").alias("loss"))
    return sequence_number(e, ["run_id"], ["ts", "event_id"], "step").select("run_id", "step", "loss")


def epoch_of(step, itersize: int):
    return F.floor((F.col(step) - 1) / F.lit(itersize)).cast("int") + 1


def epoch_loss(train_log: DataFrame, itersize: int = ITERSIZE, niters: int | None = None) -> DataFrame:
    """G1: mean loss of every ``itersize`` steps of the whole log, or of its first
    ``niters`` epochs if a stop is asked for.

    (run_id, epoch, loss, n_steps) — the true mean of the epoch's steps.
    """
    t = train_log if niters is None else train_log.filter(F.col("step") <= niters * itersize)
    return (t.withColumn("epoch", epoch_of("step", itersize))
            .groupBy("run_id", "epoch").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_steps")))


def validation_epochs(dev_log: DataFrame, freq: int = VALIDATE_FREQ) -> DataFrame:
    """Only epochs where validation ran (epoch % freq == 0)."""
    return dev_log.filter(F.col("epoch") % freq == 0)


def best_epoch(dev_log: DataFrame, metric: str, freq: int | None = VALIDATE_FREQ) -> DataFrame:
    """Per run, the validation epoch with the best ``metric``; the earliest wins ties
    (the trainer only replaces its best on a strictly greater value).

    The window holds one row per validated epoch of a run (bounded by niters).
    """
    d = dev_log if freq is None else validation_epochs(dev_log, freq)
    d = d.filter(F.col("metric") == metric)
    w = Window.partitionBy("run_id").orderBy(F.round("value", 9).desc(), F.col("epoch").asc())
    return (d.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("run_id", "epoch", "metric", "value"))


def select_metrics(dev_log: DataFrame, names: Sequence[str] = DEFAULT_METRICS,
                   prefix: str = DEV_PREFIX) -> DataFrame:
    """Keep the named metrics and prefix them (``dev-map``...)."""
    return (dev_log.filter(F.col("metric").isin(*names))
            .withColumn("metric", F.concat(F.lit(prefix), F.col("metric"))))
