"""Publishing results safely (S8, S9): versions, a pointer table, job keys.

A publication is a folder ``<root>/<name>`` with

    versions/<id>   Parquet folders, each written whole and never changed
    pointer         JSON lines (job, seq, value, version), one small file a publication

Data are written first, the pointer after them, so a reader never sees a half-written
version and a job that died leaves the last one in place.  A job is named by its key: a
rerun of a published job adds nothing (or, with ``replace``, takes the old version's
place).  ``read_best`` gives the version of the greatest value under the one stable name;
``read_all`` the rows of all jobs, each once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "job string, seq long, value double, version string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pointers(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(job, seq, value, version): the current version of every job."""
    path = f"{root}/{name}/pointer"
    if not _exists(spark, path):
        return spark.createDataFrame([], POINTER)
    # of two publications of one job the later counts; of two at once the greater version id
    last = Window.partitionBy("job").orderBy(F.col("seq").desc(), F.col("version").desc())
    return (spark.read.schema(POINTER).json(path).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k"))


def publish(df: DataFrame, root: str, name: str, job: str, value: float | None = None, replace: bool = False,
            partition_cols: tuple[str, ...] = ()) -> bool:
    """Write ``df`` as job ``job``'s version; False if the job is published already (and
    ``replace`` is not asked for): nothing is computed or written then."""
    spark = df.sparkSession
    seq, done = pointers(spark, root, name).agg(F.coalesce(F.max("seq"), F.lit(0)),
                                                F.count(F.when(F.col("job") == job, 1))).first()
    if done and not replace:
        return False
    version = f"versions/{uuid.uuid4().hex}"
    w = df.write
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(f"{root}/{name}/{version}")
    (spark.createDataFrame([(job, seq + 1, value, version)], POINTER).coalesce(1)
     .write.mode("append").json(f"{root}/{name}/pointer"))
    return True


def read_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of all jobs' current versions and their ``job``.  Jobs are few (a pointer
    row each); an unpublished name is an error."""
    current = pointers(spark, root, name).select("job", "version").collect()
    if not current:
        raise FileNotFoundError(f"nothing is published as {name}")
    path = {f"{root}/{name}/{r.version}": r.job for r in current}
    parts = [spark.read.parquet(p).withColumn("job", F.lit(job)) for p, job in sorted(path.items(), key=lambda x: x[1])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_best(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version with the greatest value, of equal ones the earliest (as a trainer keeps
    its best until a strictly better one comes), with its ``job``."""
    best = (pointers(spark, root, name).filter("value is not null and not isnan(value)")
            .orderBy(F.col("value").desc(), "seq").first())
    if best is None:
        raise FileNotFoundError(f"nothing with a value is published as {name}")
    return spark.read.parquet(f"{root}/{name}/{best.version}").withColumn("job", F.lit(best.job))
