"""Where jobs put what must outlive an executor: the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="platen-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared folder: work done so far isn't repeated, and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, but as Parquet: only the columns that a later step asks for are read again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the job's shuffle files go when it ends; what is read later is the table
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, and so the texts that a Python worker holds at a time; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or a longer one that no column of the frames has (in any case of letters)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def versioned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the same and version (int): 0, but 0, 1, ... for the different texts of a repeated doc_id.

    Only ids and 64-bit text hashes are shuffled. Where no doc_id has several texts, as usual, the texts are not joined with anything.
    """
    key = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x != y").select("doc_id")
    texts = docs.select("doc_id", key.alias("key")).join(several, "doc_id", "left_semi").distinct()
    ranked = stored(texts.withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1), "versions")
    if ranked.isEmpty():
        return docs.withColumn("version", F.lit(0))
    return docs.withColumn("key", key).join(ranked, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("version", F.lit(0)).alias("version"))
