"""Session-level helpers: time zone, scratch storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All time arithmetic is UTC; file timestamps without zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves a one-machine session (tests); on a
    cluster it would hold only a part of every table, so it is refused there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """In any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read many; used where several actions reuse one heavy result."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a wide window stage in one task: a row of the dense features holds about 10 kB in its chain of sorts.
TASK_ROWS = 40_000


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """Write a narrow table once and deal it out by key to as many partitions as its rows need.

    Windows over the keys then add no exchange. Spark sizes partitions by the compressed bytes of
    the shuffle; behind a chain of wide windows a task's memory would grow with the table.
    """
    d = materialize(df, "dealt")
    return d.repartition(max(1, -(-d.count() // rows)), *keys)
