"""Sinks: zstd Parquet tapes, CSV summaries, stage reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.audits import fingerprint
from ..session import exists


def write_tape(df: DataFrame, path: str, partition: str | None = "origin", sort: list[str] | None = None) -> str:
    """Partitioned zstd Parquet; adds partitions to a tape and refuses those it already has.

    Rows are clustered by the partition column plus a hash of the sort columns'
    first entry, so a large origin is written by several tasks.
    """
    if partition:
        salt = F.pmod(F.xxhash64(*(sort or df.columns[:1])), F.lit(16))
        df = df.repartition(F.col(partition), salt)
    if sort:
        df = df.sortWithinPartitions(*([partition] if partition else []), *sort)
    spark = df.sparkSession
    add = partition is not None and exists(spark, path)
    if add:
        name = F.col(partition).cast("string").alias(partition)
        again = spark.read.parquet(path).select(name).distinct().join(df.select(name).distinct(), partition, "left_semi").limit(5).collect()
        if again:
            raise ValueError(f"{path} already holds {partition} {sorted(r[0] for r in again)}")
    w = df.write.mode("append" if add else "errorifexists").option("compression", "zstd")
    (w.partitionBy(partition) if partition else w).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def missing_partitions(spark: SparkSession, path: str, column: str, wanted: DataFrame) -> DataFrame:
    """Partitions of ``wanted`` not yet written (resume)."""
    if not exists(spark, path):
        return wanted.select(column).distinct()
    have = spark.read.parquet(path).select(column).distinct()
    return wanted.select(column).distinct().join(have, column, "left_anti")


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: DataFrame) -> tuple[DataFrame, bool]:
    """Return the stored stage when it was finished and the fingerprint of ``key`` is unchanged, else build and store it.

    ``key`` holds every column that the stage depends on. A stage that a killed job left half
    written has no ``_SUCCESS`` and is written anew.
    """
    row = fingerprint(key).head()
    tag = f"{row['rows']}-{row['first_sum']}-{row['second_sum']}"
    target = f"{path.rstrip('/')}/{tag}"
    if exists(spark, f"{target}/_SUCCESS"):
        return spark.read.parquet(target), True
    build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target), False
