"""Mixing sources to target weights (operator 4) by weighted fair queueing.

Every source gets a target: its weight's share of the budget, at most ``max_passes``
times its size, the excess going to the others by weight.  The documents of a source are
shuffled, pass after pass; a copy's *virtual finish time* is the number of words the
source has given up to its end, divided by the source's target.  All copies are sorted by
it and the first ones whose words fit the budget are taken, so all sources advance in
step and each ends near its target.

No source is ever held by one task: its copies are dealt into hash ranges of about
``ROWS_PER_BLOCK`` rows, sums of the ranges give each its offset, and only a range is
summed in order.  The global sort works the same way over ranges of the finish time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = 42
ROWS_PER_BLOCK = 10_000
# The per-source table is broadcast below this many rows, else joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, max_passes: int = MAX_PASSES,
            share: float = 1.0) -> DataFrame:
    """Add source_no (1.. by code point, null last), weight and target to a table of
    (source, source_size, ...), one row per source.

    Filling by weight with limits: let the sources be ordered by limit / weight.  The
    first one whose limit is not reached, when all before it stand at theirs, sets the
    level for itself and all after it."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = per_source.withColumn("source_no", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    t = t.withColumn("weight", w).withColumn("limit", (F.col("source_size") * max_passes).cast("double"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    t = (t.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
         .withColumn("full", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
         .withColumn("at", F.row_number().over(order)))
    first = F.min(F.when(F.col("limit") > F.col("weight") * F.col("level"), F.struct("at", "level"))).over(whole)
    level = first.getField("level")
    return t.withColumn("target", F.coalesce(F.least(F.col("limit"), F.col("weight") * level), F.col("limit"))).drop(
        "limit", "full", "rest", "level", "at")


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = WEIGHTS, max_passes: int = MAX_PASSES, share: float = 1.0,
         seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, copies).

    documents: uid, doc_id, source, size, source_size, target - one row per row of ``df``.
    copies: uid, doc_id, size, pass_no, finish (virtual finish time), words_before (place
    in the mix) - one row per copy that the mix takes, whole documents only.

    Sizes are words of the whole text (null: 0).  Null sources are one source, the last
    by order.  Repeated rows are separate documents.  Ties are ordered by id and size.
    Only the three named columns are read.  Reruns on the same rows give the same plan:
    the shuffle is an md5 of seed, pass and id.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "mix-sizes")
    (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
               n_words(F.col(text_col)).alias("size"))
     .withColumn("uid", F.monotonically_increasing_id()).write.parquet(path))
    base = spark.read.parquet(path)
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    src_path = scratch_dir(spark, "mix-sources")
    targets(per_source, weights, max_passes, share).write.parquet(src_path)
    src = spark.read.parquet(src_path)
    n_sources, n_rows, budget = src.agg(F.count(F.lit(1)), F.sum("n_docs"), F.max("total")).first()
    small = F.broadcast(src) if n_sources <= MAX_BROADCAST_SOURCES else src
    docs = (base.withColumnRenamed("source", "source_")
            .join(small, F.col("source_").eqNullSafe(F.col("source"))).drop("source_"))

    # copies in hash ranges of their source and pass
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "pass_no", "doc_id"))
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (docs.select("uid", "doc_id", "size", "source_no", "source_size", "target", "n_docs",
                          F.explode(F.sequence(F.lit(1), F.lit(max_passes))).alias("pass_no"))
              .withColumn("h", h)
              .withColumn("block", F.floor(part * F.ceil(F.col("n_docs") / ROWS_PER_BLOCK))).drop("n_docs"))
    keys = ["source_no", "pass_no", "block"]
    before = Window.partitionBy("source_no").orderBy("pass_no", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (copies.groupBy(*keys).agg(F.sum("size").alias("n"))
               .select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy(*keys).orderBy("h", "doc_id", "size", "uid")
              .rowsBetween(Window.unboundedPreceding, 0))
    given = (copies.join(offsets, keys)
             .withColumn("given", F.col("offset") + F.sum("size").over(inside))
             .withColumn("finish", F.when(F.col("target") > 0, F.col("given") / F.col("target")).otherwise(F.lit(0.0))))
    # global order by finish time, in ranges of it: x / (1 + x) grows with x and stays below 1
    n_ranges = max(1, -(-int(n_rows or 0) * max_passes // ROWS_PER_BLOCK))
    given = given.select("uid", "doc_id", "size", "pass_no", "source_no", "finish", F.floor(
        F.col("finish") / (F.col("finish") + 1) * n_ranges).alias("range"))
    run_path = scratch_dir(spark, "mix-finish")
    given.write.parquet(run_path)
    given = spark.read.parquet(run_path)
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (given.groupBy("range").agg(F.sum("size").alias("n"))
              .select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")))
    row = (Window.partitionBy("range").orderBy("finish", "source_no", "pass_no", "doc_id", "size", "uid")
           .rowsBetween(Window.unboundedPreceding, 0))
    taken = (given.join(starts, "range")
             .withColumn("words_before", F.col("start") + F.sum("size").over(row) - F.col("size"))
             .filter(F.col("words_before") + F.col("size") <= F.lit(float(budget or 0)))
             .select("uid", "doc_id", "size", "pass_no", "finish", "words_before"))
    return docs.select("uid", "doc_id", "source", "size", "source_size", "target"), taken


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **kw) -> DataFrame:
    """The mixed documents with the columns of ``df``: a document taken k times is k
    rows, and the rows lie in the order of the mix (range-sorted by it).

    Rows that share id and size share their copies evenly."""
    _, taken = plan(df, id_col, text_col, source_col, **kw)
    copies = (taken.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"))
              .agg(F.sort_array(F.collect_list("words_before")).alias("_places"),
                   F.countDistinct("uid").alias("_rows")))
    # the row goes along as one column, so that no working column clashes with its names
    keyed = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id0"),
                      n_words(F.col(text_col)).alias("_size0"), F.xxhash64(text_col).alias("_h"))
    out = keyed.join(copies, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_size0") == F.col("_size")))
    # the i-th of the rows with one id and size takes every _rows-th place
    i = F.row_number().over(Window.partitionBy("_id0", "_size0").orderBy("_h"))
    mine = F.filter("_places", lambda _, k: k % F.col("_rows") == F.col("_i") - 1)
    out = out.withColumn("_i", i).withColumn("_place", F.explode(mine))
    return out.repartitionByRange("_place").sortWithinPartitions("_place").select("row.*")
