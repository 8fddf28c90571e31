"""Scans of the raw file formats into the canonical long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalar import normalize_node, parse_ts, valid_code

CORRUPT = "_corrupt"

JOB_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("job_id", "submit_time", "start_time", "end_time")],
    *[T.StructField(n, T.DoubleType()) for n in ("duration", "gpu_time")],
    *[T.StructField(n, T.IntegerType()) for n in ("gpu_num", "node_num", "cpu_num")],
    *[T.StructField(n, T.StringType()) for n in ("type", "user", "state", "queue")],
])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a wide file: one line is read, not the data."""
    return spark.read.option("header", True).csv(path).columns


def checked_csv(spark: SparkSession, schema: T.StructType):
    """Columns are taken by position, so a file whose header has another order is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False)


def read_wide_csv(spark: SparkSession, path: str, time_col: str = "Time", entities: list[str] | None = None,
                  value: str = "value") -> DataFrame:
    """Wide time-series CSV (one column per entity) to ``entity, ts, value``; empty cells are NULL.

    With ``entities`` only those columns are parsed: the CSV reader prunes the rest.
    """
    cols = csv_header(spark, path)
    ids = [c for c in cols if c != time_col]
    schema = T.StructType([T.StructField(c, T.StringType() if c == time_col else T.DoubleType()) for c in cols])
    df = checked_csv(spark, schema).option("nullValue", "").csv(path)
    keep = ids if entities is None else [e for e in ids if e in set(entities)]
    df = df.select(parse_ts(time_col).alias("ts"), *[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) for c in keep])
    return df.unpivot(["ts"], keep, "entity", value)


def read_fault_log(spark: SparkSession, path: str, time_col: str = "Time", strict: bool = True) -> DataFrame:
    """Wide fault log to non-zero codes; ``strict`` fails the job on a fractional or negative code."""
    d = read_wide_csv(spark, path, time_col, value="raw")
    if strict:
        bad = (F.col("raw") != F.rint("raw")) | (F.col("raw") < 0)
        d = d.withColumn("raw", F.when(bad, F.raise_error(F.concat(F.lit("fractional or negative code at "), F.col("entity")))).otherwise(F.col("raw")))
    return d.select("entity", "ts", valid_code("raw").alias("code")).where(F.col("code") != 0)


def read_telemetry(spark: SparkSession, base: str, metrics: list[str], t_from=None, t_to=None, stats=("mean",), time_col: str = "Time_5m",
                   id_col: str = "gpu_id") -> dict[str, DataFrame]:
    """Long Parquet per metric with column pruning and a pushed time range."""
    out = {}
    for m in metrics:
        d = spark.read.parquet(f"{base}/{m}.parquet")
        if t_from is not None:
            d = d.where(F.col(time_col) >= F.lit(t_from))
        if t_to is not None:
            d = d.where(F.col(time_col) < F.lit(t_to))
        out[m] = d.select(F.col(id_col).alias("entity"), F.col(time_col).alias("ts"), *[F.col(f"{m}_{s}") for s in stats])
    return out


def read_onsets(spark: SparkSession, path: str) -> DataFrame:
    """Onset ledger without exact duplicates."""
    d = spark.read.parquet(path)
    return d.select(F.col("gpu_id").alias("entity"), F.col("onset_time").alias("ts"), F.col("xid_code").alias("code")).dropDuplicates()


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job trace; unparsable timestamps become NULL."""
    d = checked_csv(spark, JOB_SCHEMA).csv(path)
    return d.withColumns({c: parse_ts(c) for c in ("submit_time", "start_time", "end_time")})


def read_node_power(spark: SparkSession, paths: list[str], power_col: str = "Sys_Total_Power") -> DataFrame:
    """Long node-power files: bad times dropped, node names normalised, values <= 0 are NULL."""
    schema = T.StructType([T.StructField("Time", T.StringType()), T.StructField(power_col, T.DoubleType()), T.StructField("node", T.StringType())])
    d = checked_csv(spark, schema).csv(paths)
    p = F.col(power_col)
    return d.select(normalize_node("node").alias("node"), parse_ts("Time").alias("ts"), F.when(p > 0, p).alias("power")).where(F.col("ts").isNotNull())


def read_with_corrupt(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Permissive read that keeps malformed lines in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def malformed_rows(df: DataFrame) -> DataFrame:
    """Rows, malformed rows and parsed values per column; using every column makes Spark parse whole lines."""
    cols = [c for c in df.columns if c != CORRUPT]
    return df.agg(F.count("*").alias("rows"), F.count(CORRUPT).alias("malformed"), *[F.count(c).alias(f"parsed_{c}") for c in cols])
