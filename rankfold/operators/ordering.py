"""Row positions inside groups without sending a group to one task.

``row_number()`` over a window puts a whole group in one task.  For groups that
can hold a large share of all rows (one training run, one event type) this
module numbers rows with a range-partitioned sort instead:

1. ``repartitionByRange`` on (group, order) splits even a hot group over many
   tasks; ``sortWithinPartitions`` orders each task's rows;
2. ``monotonically_increasing_id`` gives each row its index inside its task;
3. a small per-(task, group) table (count, first index) gets running offsets
   with a window over at most one row per task of the group;
4. position = offset + index - first index + 1.

Step 3's table has at most (#tasks + #groups) rows.  The numbering is exact
(1..n per group); with a unique order key it is also the same on every retry.

The indexed rows are used twice (rows and per-task counts).  Range partition
bounds come from a sample seeded per RDD, so two evaluations could cut the data
differently; the indexed rows are therefore written once to a
table in the shared folder and both branches read that copy; the small block table is
written too, so that its size is known before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .sizing import broadcast_bounded, row_bound


def sequence_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                    out: str = "step", num_partitions: int | None = None) -> DataFrame:
    g, o = list(group_cols), list(order_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *g, *o).sortWithinPartitions(*g, *o)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_li", F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    s = checkpoint(s)
    blocks = s.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_li").alias("_lo"))
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    blocks = checkpoint(blocks.select("_pid", *g, "_off", "_lo"))
    return (s.join(broadcast_bounded(blocks, row_bound(blocks)), ["_pid", *g])
            .withColumn(out, F.col("_off") + F.col("_li") - F.col("_lo") + 1)
            .drop("_pid", "_li", "_off", "_lo"))
