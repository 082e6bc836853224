"""Durable cuts in the lineage: tables written to the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Only a local master, as in tests, may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="grantscope-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a durable cut that a lost executor can't undo."""
    spark = df.sparkSession
    path = f"{cuts_of(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_place(spark: SparkSession) -> SparkSession:
    """A session like `spark` whose joins leave rows that are dealt by some of the join's keys where they lie.

    Spark reads this setting when a query runs, so that it can't be lent to the caller's session and put back.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # what filters imply is not spelt out for every column: a driver ran out of memory over it
    own.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return own


def cut_by(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """A cut whose rows lie in `parts` buckets by `key`: groups and joins by `key` and more don't move them again."""
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    dealt = df.repartition(parts, key).write.format("parquet").option("path", f"{cuts_of(df.sparkSession)}/{name}").option("compression", "zstd")
    dealt.bucketBy(parts, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def cuts_of(spark: SparkSession) -> str:
    """The folder of this application's cuts."""
    return f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this application's cuts. Results not yet written can't be read after it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cuts_of(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
