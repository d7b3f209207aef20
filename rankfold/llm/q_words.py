"""Queries of the operators on words (11, 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import periodic, spelling
from .q_tokens import documents

WORD = r"[^\x20\x09-\x0D]++"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda's variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of a document; of about every tenth one the words from some place on are
    replaced by the repetition of the first few of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " ")

    # (a division by zero words would be an error)
    change = lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(text)
    return F.when(h % 10 == 0, bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), change)).otherwise(text)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find(docs).drop("text")
    # greatest length / period without rounding; runs come by start, then period
    better = lambda a, r: a.isNull() | (r.length * a.period > a.length * r.period)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_spelling": op11_spelling, "op13_periodic": op13_periodic}
ORACLE: dict[str, str] = {}
