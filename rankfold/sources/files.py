"""Real file formats (S1, S3-S9): trec-web corpus shards, qrels, topics, fold JSON,
run files, run and metric sinks.  Readers and writers are Spark jobs over the
files; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS_RE, parse_trecweb, split_docid
from ..operators.sizing import broadcast_bounded

# Fixed values of the formats.
DOC_END = "\n</DOC>"
TOPIC_END = "</top>"
RUN_TAG_Q0 = "Q0"

FOLDS_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("train_qids", T.ArrayType(T.StringType())),
    T.StructField("predict", T.StructType([
        T.StructField("dev", T.ArrayType(T.StringType())),
        T.StructField("test", T.ArrayType(T.StringType())),
    ])),
]))


# ------------------------------------------------------------------ S1 / T1
def read_trecweb(spark: SparkSession, path: str) -> DataFrame:
    """S1 + T1: (path, split_start, rec_no, docid, html, parse_error) from
    ``<DOC>...</DOC>`` records.

    Records start at a line starting ``<DOC>`` and end at a line starting ``</DOC>``
    (multi-character line separator, so ``</DOC>`` inside a line does not split); shards
    are found recursively and gzip is decoded by the reader (one task per shard).
    Undecodable bytes arrive as U+FFFD and are dropped; text before the first ``<DOC>`` of
    a record (a shard's tail) is not a record.

    Records are ordered by (path, split_start, rec_no): the split's offset in the file and
    a number that grows inside the split, so numbering needs no shuffle.  A repeated docid
    keeps its last record; that is the only shuffle, and a map-side limit sends at most
    one record per docid and task.  Nothing runs while the plan is built.
    """
    return _last_records(_records(spark, path))


def _records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All records of the files, as ``read_trecweb`` but with repeated ids."""
    raw = (spark.read.option("lineSep", DOC_END).option("recursiveFileLookup", "true")
           .text(paths)
           .select(F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_block_start").alias("split_start"),
                   F.regexp_replace("value", "\uFFFD", "").alias("value"),
                   F.monotonically_increasing_id().alias("rec_no")))
    rec = raw.filter(F.col("value").rlike(r"(?m)^<DOC>")).withColumn(
        "value", F.regexp_replace("value", r"(?s)^(?:|.*?\n)<DOC>", "<DOC>"))
    docid, html, err = parse_trecweb(F.col("value"))
    return rec.select(*_PLACE, docid.alias("docid"), html.alias("html"), err.alias("parse_error"))


_PLACE = ("path", "split_start", "rec_no")


def _last_records(parsed: DataFrame) -> DataFrame:
    """A repeated docid keeps its last record; one without an id is its own group."""
    group = F.coalesce(F.col("docid"), F.concat_ws("|", F.lit(""), *_PLACE))
    last = Window.partitionBy("_g").orderBy(*[F.col(c).desc() for c in _PLACE])
    return (parsed.withColumn("_g", group).withColumn("_k", F.row_number().over(last)).filter("_k = 1")
            .drop("_g", "_k"))


# ------------------------------------------------------------------ L2 on shards
# Above this many shards the whole corpus is scanned: a list of them would be of its size.
MAX_ASKED_SHARDS = 100_000
_PLAIN_NAME = r"^\w[\w.]*$"


def asked_shards(ids: DataFrame, limit: int = MAX_ASKED_SHARDS) -> list[tuple[str, str]] | None:
    """The distinct (dir, file) of the asked ids (T5), sorted; None if more than ``limit``.

    Ids without these parts, or with other signs than letters, digits, _ and . in them,
    are in no shard."""
    p = split_docid("docid")
    named = ids.select(p.getField("dir").alias("dir"), p.getField("file").alias("file")).filter(
        F.col("dir").rlike(_PLAIN_NAME) & F.col("file").rlike(_PLAIN_NAME))
    got = named.distinct().limit(limit + 1).collect()
    return None if len(got) > limit else sorted((r.dir, r.file) for r in got)


def existing_shards(spark: SparkSession, root: str, shards: list[tuple[str, str]]) -> list[str]:
    """Paths of those shards that exist.  Only the asked names are looked up, one request
    for each folder, in whatever store Spark reads."""
    jvm = spark._jvm
    folders: dict[str, list[str]] = {}
    for folder, file in shards:
        folders.setdefault(folder, []).append(file)
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for folder, files in folders.items():
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder}/{{{','.join(files)}}}.gz"))
        out += [f.getPath().toString() for f in found or []]
    return sorted(out)


def fetch_from_shards(spark: SparkSession, root: str, ids: DataFrame, ids_bound: int | None = None,
                      max_shards: int = MAX_ASKED_SHARDS) -> DataFrame:
    """L2 + S1: (path, docid, html, parse_error) of the asked ids (column docid) from a corpus
    laid out as ``<root>/<dir>/<file>.gz``.

    An id names its shard, so only the shards asked for are opened; the ids are broadcast
    behind their bound and cut the records before anything is shuffled.  Missing shards and
    ids give no row (``missing_docs`` tells them); a repeated record counts by its last."""
    wanted = ids.select("docid").distinct()
    shards = asked_shards(wanted, max_shards)
    paths = [root] if shards is None else existing_shards(spark, root, shards)
    if not paths:
        return spark.createDataFrame([], "path string, docid string, html string, parse_error string")
    mine = _records(spark, paths).join(broadcast_bounded(wanted, ids_bound), "docid", "left_semi")
    return _last_records(mine).select("path", "docid", "html", "parse_error")


def write_shards(df: DataFrame, root: str, header_col: str = "url") -> None:
    """Write (docid, <header_col>, html) as ``<root>/<dir>/<file>.gz``, the shard named by the
    id (T5).  A shard's records are ordered by id and written by one task, as a gzip file
    must be; the finished files are then moved to their names (one rename for each shard)."""
    spark = df.sparkSession
    p = split_docid("docid")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.withColumn("_dir", p.getField("dir")).withColumn("_file", p.getField("file"))
              .repartition(n, "_dir", "_file").sortWithinPartitions("_dir", "_file", "docid"))
    staged = f"{root.rstrip('/')}/_staged"
    (placed.select(_record(header_col).alias("value"), "_dir", "_file")
     .write.option("compression", "gzip").partitionBy("_dir", "_file").text(staged))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{staged}/_dir=*/_file=*/part-*")) or []:
        part = f.getPath()
        file = part.getParent().getName().split("=", 1)[1]
        folder = part.getParent().getParent().getName().split("=", 1)[1]
        fs.mkdirs(path(f"{root}/{folder}"))
        if not fs.rename(part, path(f"{root}/{folder}/{file}.gz")):
            raise OSError(f"could not publish shard {folder}/{file}")
    fs.delete(path(staged), True)


def _record(header_col: str) -> F.Column:
    return F.concat(F.lit("<DOC>\n<DOCNO>"), F.col("docid"), F.lit("</DOCNO>\n<DOCHDR>\n"),
                    F.coalesce(F.col(header_col), F.lit("")), F.lit("\n</DOCHDR>\n"), F.col("html"), F.lit(DOC_END))


def write_trecweb(df: DataFrame, path: str, shard_col: str | None = None, header_col: str = "url") -> None:
    """Write (docid, <header_col>, html) as gzip trec-web shards (for tests and exports)."""
    out = df.select(_record(header_col).alias("value"), *([shard_col] if shard_col else []))
    w = out.write.mode("overwrite").option("compression", "gzip")
    if shard_col:
        w = w.partitionBy(shard_col)
    w.text(path)


# ------------------------------------------------------------------ S3 qrels
def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """S3: whitespace table ``qid iter docid rel`` -> (qid, docid, rel); malformed
    lines are kept with ``parse_error``."""
    p = F.split(F.trim(F.col("value")), r"\s+")
    t = spark.read.text(path).filter(F.trim("value") != "")
    ok = (F.size(p) == 4) & F.get(p, 3).rlike(r"^-?\d+$")
    return t.select(F.get(p, 0).alias("qid"), F.get(p, 2).alias("docid"),
                    F.when(ok, F.get(p, 3).cast("int")).alias("rel"),
                    F.when(~ok, F.col("value")).alias("parse_error"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.concat_ws(" ", "qid", F.lit("0"), "docid", F.col("rel").cast("string")).alias("v")) \
        .write.mode("overwrite").text(path)


# ------------------------------------------------------------------ S4 topics
def read_topics(spark: SparkSession, path: str, query_type: str | None = None) -> DataFrame:
    """Trec topic file -> (qid, query_type, query) for title and desc.

    ``<num> Number: 301``, ``<title> text``, ``<desc> Description: text``; text
    runs to the next tag; whitespace is squashed.
    """
    def field(tag: str, prefix: str = "") -> F.Column:
        v = F.regexp_extract("value", rf"(?s)<{tag}>\s*(?:{prefix})?(.*?)(?=<[a-z]+>|$)", 1)
        return F.trim(F.regexp_replace(v, WS_RE, " "))

    t = (spark.read.option("lineSep", TOPIC_END).text(path)
         .filter(F.col("value").contains("<top>"))
         .select(F.regexp_extract("value", r"<num>\s*(?:Number:)?\s*(\S+)", 1).alias("qid"),
                 F.explode(F.array(
                     F.struct(F.lit("title").alias("query_type"), field("title").alias("query")),
                     F.struct(F.lit("desc").alias("query_type"), field("desc", r"Description:\s*").alias("query")),
                 )).alias("t"))
         .select("qid", "t.query_type", "t.query"))
    return t if query_type is None else t.filter(F.col("query_type") == query_type)


def write_topics(topics: DataFrame, path: str) -> None:
    """(qid, title, desc) -> trec topic file."""
    v = F.concat(F.lit("<top>\n<num> Number: "), F.col("qid"), F.lit("\n<title> "), F.col("title"),
                 F.lit("\n<desc> Description:\n"), F.col("desc"), F.lit("\n<narr> Narrative:\n\n"), F.lit(TOPIC_END))
    topics.select(v.alias("value")).write.mode("overwrite").text(path)


# ------------------------------------------------------------------ S5 folds
def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Fold JSON -> distinct (fold, split, qid); repeated qids collapse (set semantics)."""
    j = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", FOLDS_SCHEMA).alias("m"))
    f = j.select(F.explode("m").alias("fold", "v"))
    lists = f.select("fold", F.explode(F.array(
        F.struct(F.lit("train").alias("split"), F.col("v.train_qids").alias("qids")),
        F.struct(F.lit("dev").alias("split"), F.col("v.predict.dev").alias("qids")),
        F.struct(F.lit("test").alias("split"), F.col("v.predict.test").alias("qids")),
    )).alias("s"))
    return (lists.select("fold", F.col("s.split").alias("split"), F.explode_outer("s.qids").alias("qid"))
            .filter(F.col("qid").isNotNull()).distinct())


def write_folds(folds: DataFrame, path: str) -> None:
    """(fold, split, qid) -> one JSON object (bounded by topics x folds; built on an executor)."""
    per = folds.groupBy("fold", "split").agg(F.array_sort(F.collect_set("qid")).alias("qids"))
    by_fold = per.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("split", "qids"))).alias("m"))
    obj = by_fold.select("fold", F.struct(
        F.coalesce(F.col("m")["train"], F.array().cast("array<string>")).alias("train_qids"),
        F.struct(F.coalesce(F.col("m")["dev"], F.array().cast("array<string>")).alias("dev"),
                 F.coalesce(F.col("m")["test"], F.array().cast("array<string>")).alias("test")).alias("predict"),
    ).alias("v"))
    obj.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("fold", "v")))).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)


# ------------------------------------------------------------------ S6 / S7 / S8 runs
def read_run(spark: SparkSession, path: str, expect: dict | None = None, partition_cols=()) -> DataFrame:
    """``qid Q0 docid rank score tag`` -> (run_id, qid, docid, rank, score), and the
    folders' values of ``partition_cols`` (as written by ``write_run``).

    S7: with ``expect`` (e.g. {"k1": 0.9, "b": 0.4}) a ``params_ok`` column tells
    whether the tag names exactly those parameter values (``k1=0.90`` ...).
    """
    p = F.split(F.trim(F.col("value")), r"\s+")
    r = (spark.read.text(path).filter(F.trim("value") != "")
         .select(F.get(p, 5).alias("run_id"), F.get(p, 0).alias("qid"), F.get(p, 2).alias("docid"),
                 F.get(p, 3).try_cast("int").alias("rank"), F.get(p, 4).try_cast("double").alias("score"),
                 *partition_cols))
    if expect:
        ok = F.lit(True)
        for k, v in expect.items():
            got = F.regexp_extract("run_id", rf"{k}=([0-9.]+)", 1)
            ok = ok & (got != "") & (F.abs(got.cast("double") - F.lit(float(v))) < F.lit(1e-9))
        r = r.withColumn("params_ok", ok)
    return r


def write_run(run: DataFrame, path: str, run_id: str | None = None, partition_cols=()) -> None:
    """Trec run text, one folder per partition value (e.g. run_id, fold, split).

    Scores are written in their shortest exact form so that reading the file
    back gives the same doubles (and the same ranks)."""
    rid = F.lit(run_id) if run_id else F.col("run_id")
    line = F.concat_ws(" ", "qid", F.lit(RUN_TAG_Q0), "docid", F.col("rank").cast("string"),
                       F.col("score").cast("string"), rid)
    out = run.select(line.alias("value"), *partition_cols)
    w = out.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.text(path)


# ------------------------------------------------------------------ S9 metrics
def write_metrics(metrics: DataFrame, path: str, partition_cols=("run_id",)) -> None:
    """Append metric rows to a parquet table (the tracker stand-in)."""
    metrics.write.mode("append").partitionBy(*partition_cols).parquet(path)
