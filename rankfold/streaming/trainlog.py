"""Live epoch roll-up of a training log (G1 on a stream).

The trainer logs one loss per step while it trains.  Reading that log as a
stream, the per-epoch mean is kept as Structured Streaming state with one row
per (run_id, epoch): the state grows with epochs, not with steps.  The sink is a
Parquet folder that every micro-batch replaces; it and the checkpoint location lie in
shared folders, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trainlog import ITERSIZE, epoch_of
from ..session import scratch_dir

LOG_SCHEMA = "run_id string, step long, loss double"


def epoch_loss_stream(log: DataFrame, itersize: int = ITERSIZE, niters: int | None = None) -> DataFrame:
    """Streaming (run_id, epoch, loss, n_steps): the same rows as ``trainlog.epoch_loss``."""
    if niters is not None:
        log = log.filter(F.col("step") <= niters * itersize)
    return (log.withColumn("epoch", epoch_of("step", itersize))
            .groupBy("run_id", "epoch")
            .agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_steps")))


def start_epoch_loss(spark: SparkSession, log_dir: str, out_dir: str, itersize: int = ITERSIZE,
                     niters: int | None = None, available_now: bool = False,
                     checkpoint_location: str | None = None) -> StreamingQuery:
    """Watch ``log_dir`` (parquet files of ``LOG_SCHEMA``) and keep the epoch table
    as Parquet in ``out_dir`` (complete mode: the folder is the whole roll-up after every
    micro-batch; nothing passes through the driver)."""
    log = spark.readStream.schema(LOG_SCHEMA).parquet(log_dir)
    w = (epoch_loss_stream(log, itersize, niters).writeStream
         .outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out_dir))
         .option("checkpointLocation", checkpoint_location or scratch_dir(spark, "stream")))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
