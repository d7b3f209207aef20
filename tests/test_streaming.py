from pyspark.sql import functions as F

from rankfold.operators import trainlog as G
from rankfold.sources import testbed
from rankfold.streaming.trainlog import start_epoch_loss


def test_stream_matches_batch(spark, tmpdir_path):
    log = G.train_log_from_events(testbed.table(spark, "/root/testdata/sf0.001", "events"))
    log = log.select("run_id", F.col("step").cast("long").alias("step"), "loss")
    # two arrivals: first and second half of the steps
    log.filter("step <= 100").write.mode("append").parquet(tmpdir_path + "/log")
    ckpt = tmpdir_path + "/stream-ckpt"
    q = start_epoch_loss(spark, tmpdir_path + "/log", tmpdir_path + "/out", itersize=64, available_now=True,
                         checkpoint_location=ckpt)
    q.awaitTermination()
    # the restarted query resumes from its checkpoint: only the new files are read,
    # the aggregation state of the first run is kept
    log.filter("step > 100").write.mode("append").parquet(tmpdir_path + "/log")
    q = start_epoch_loss(spark, tmpdir_path + "/log", tmpdir_path + "/out", itersize=64, available_now=True,
                         checkpoint_location=ckpt)
    q.awaitTermination()
    live = {(r.run_id, r.epoch): (round(r.loss, 9), r.n_steps) for r in spark.read.parquet(tmpdir_path + "/out").collect()}
    batch = {(r.run_id, r.epoch): (round(r.loss, 9), r.n_steps) for r in G.epoch_loss(log, 64).collect()}
    assert live == batch
