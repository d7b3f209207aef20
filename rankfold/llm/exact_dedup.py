"""Exact duplicates (operator 8), with DataFrame functions only.

Texts are equal when they are identical without white space.  Three stages, each
grouping by digest *and* full content, so that different texts with one digest never
meet: (1) inside each task, the map side of the first aggregation; (2) per digest and
salt, so that a hot group is spread over ``salts`` tasks; (3) per digest, over the
winners of the salts.  A group is then one row: its winner and size.  Documents look
their group up by digest alone, unless stage 3 saw a digest with several contents; then
(and only then) those digests are looked up by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

# The white space that does not count.
SPACE = " \t\n\x0b\f\r"
SALTS = 8
_SHIFT = "100000000000000000000"  # above any 64-bit rank
_TOP = "9223372036854775807"


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that orders rows: more characters first, then the smaller id, ids that
    are null last.  A decimal, so that the aggregation stays in hash tables."""
    by_id = F.expr(f"cast({_TOP} as decimal(20,0))") - doc_id.cast("decimal(19,0)") + F.lit(1)
    return (n_chars.cast("decimal(10,0)") * F.expr(f"cast('{_SHIFT}' as decimal(21,0))")
            + F.coalesce(by_id.cast("decimal(20,0)"), F.expr("cast(0 as decimal(20,0))"))).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    part = F.pmod(rank, F.expr(f"cast('{_SHIFT}' as decimal(21,0))"))
    return F.when(part > 0, (F.expr(f"cast({_TOP} as decimal(20,0))") - part + F.lit(1)).cast("long"))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.col(text_col)
    return (df.select(F.col(id_col).cast("long").alias("doc_id"), normalise(text).alias("content"),
                      F.length(F.coalesce(text, F.lit(""))).alias("n_chars"))
            .withColumn("digest", digest(F.col("content"))))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    The row with the most characters stays, then the smallest id.  Null texts count as
    empty; a null id stays only if its group has no other.  Repeated rows (one id, one
    text) are all marked as kept: they are one document (``keep`` returns it once).  Only
    the two named columns are read; an empty table gives an empty result.
    """
    rows = _rows(df, id_col, text_col, digest)
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("digest", "salt", "content")
              .agg(F.max(_rank(F.col("n_chars"), F.col("doc_id"))).alias("rank"), F.count(F.lit(1)).alias("size")))
    per_text = (salted.repartition("digest").groupBy("digest", "content")
                .agg(F.max("rank").alias("rank"), F.sum("size").alias("size")))
    # one row per digest, and the contents of digests that have several
    per_digest = per_text.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("rank").alias("rank"), F.sum("size").alias("group_size"))
    path = scratch_dir(df.sparkSession, "exact-groups")
    per_digest.write.parquet(path)
    known = df.sparkSession.read.parquet(path)
    narrow = rows.select("doc_id", "n_chars", "digest", sha256(F.col("content")).alias("text_sha256"))
    found = narrow.join(known.filter("contents = 1").drop("contents"), "digest")
    shared = known.filter("contents > 1").select("digest")
    if not shared.isEmpty():
        texts = per_text.join(shared, "digest", "left_semi").withColumnRenamed("size", "group_size")
        again = rows.join(shared, "digest", "left_semi").withColumn("text_sha256", sha256(F.col("content")))
        found = found.unionByName(again.join(texts, ["digest", "content"]).drop("content"))
    keep_id = _id_of(F.col("rank"))
    longest = F.floor(F.col("rank") / F.expr(f"cast('{_SHIFT}' as decimal(21,0))"))
    return found.select("doc_id", keep_id.alias("keep_id"), "group_size",
                        (keep_id.eqNullSafe(F.col("doc_id")) & (longest == F.col("n_chars"))).alias("kept"),
                        "text_sha256", "n_chars")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one per group of equal texts.

    Repeated rows of the winner are combined (map side first); of rows that share id,
    content and length any one stays."""
    marks = groups(df, id_col, text_col, salts).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n")).distinct()
    text = F.col(text_col)
    # the row goes along as one column, so that no working column clashes with its names
    marked = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"),
                       sha256(normalise(text)).alias("_sha"), F.length(F.coalesce(text, F.lit(""))).alias("_n")).alias("d")
    m = marks.alias("m")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("_id", "_sha", "_n")]
    kept = marked.join(m, on[0] & on[1] & on[2], "left_semi")
    return kept.dropDuplicates(["_id", "_sha", "_n"]).select("row.*")
