"""Job-trace quality, eligibility, tapes and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import DAY, SECOND, idiv
from .summaries import with_percentiles


def quality(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({
        "wait_s": (F.col("start_t") - F.col("submit_t")) / SECOND,
        "runtime_s": (F.col("end_t") - F.col("start_t")) / SECOND,
        "duration_gap_s": F.col("duration") - (F.col("end_t") - F.col("start_t")) / SECOND,
        "gpu_time_gap": F.col("gpu_time") - F.col("duration") * F.col("gpu_num"),
        "submit_day": idiv("submit_t", DAY),
    })


def eligibility(jobs: DataFrame, t0: int, t1: int, capacity: int, per_node: int = 8) -> DataFrame:
    flags = {
        "in_window": F.col("submit_t").between(t0, t1),
        "uses_gpu": F.col("gpu_num") > 0,
        "completed": F.col("state") == "COMPLETED",
        "has_duration": F.col("duration") > 0,
        "fits_cluster": F.col("gpu_num") <= capacity,
        "fits_nodes": F.col("gpu_num") <= F.col("node_num") * per_node,
    }
    all_of = None
    for f in flags.values():
        all_of = f if all_of is None else all_of & f
    return jobs.withColumns(flags | {"eligible": all_of})


def job_tape(eligible: DataFrame, t0: int) -> DataFrame:
    """Arrival seconds from the window start; rows are ordered by submit time and id when written."""
    return eligible.where("eligible").select(
        "job_id", "submit_t", idiv(F.col("submit_t") - F.lit(t0), SECOND).alias("arrival_s"),
        F.floor("duration").cast("bigint").alias("duration_s"), "gpu_num", "node_num", "cpu_num", "type", "user",
        F.col("state").alias("historical_state"))


def daily(jobs: DataFrame) -> DataFrame:
    q = quality(jobs)
    failed = F.col("state") == "FAILED"
    a = q.groupBy("submit_day").agg(
        F.count("*").alias("jobs"), F.sum("gpu_num").alias("gpus"),
        (F.sum("gpu_time") / 3600).alias("gpu_hours"), F.count_if(failed).alias("failed"), F.avg(failed.cast("double")).alias("failed_rate"))
    return with_percentiles(a, q, ["submit_day"], "wait_s", {"median_wait_s": 0.5})


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value including NULL, and the share of all rows."""
    c = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("rows"))
    total = c.agg(F.sum("rows"))
    return c.withColumn("share", F.col("rows") / total.scalar())


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quantiles, max; one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "col", "v")
    a = long.groupBy("col").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return with_percentiles(a, long, ["col"], "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def selection_bias(eligible: DataFrame) -> DataFrame:
    d = eligible.withColumn("side", F.when(F.col("eligible"), "eligible").otherwise("excluded"))
    a = d.groupBy("side").agg(
        F.count("*").alias("jobs"), (F.sum("gpu_time") / 3600).alias("gpu_hours"), F.avg((F.col("gpu_num") > 1).cast("double")).alias("multi_gpu_share"))
    return with_percentiles(a, d, ["side"], "duration", {"duration_p50": 0.5, "duration_p95": 0.95})


def summaries(jobs: DataFrame, by: list[str]) -> DataFrame:
    a = jobs.groupBy(*by).agg(F.count("*").alias("jobs"), F.sum("gpu_num").alias("gpus"),
                             F.avg((F.col("state") == "FAILED").cast("double")).alias("failed_rate"))
    return with_percentiles(a, jobs, by, "duration", {"median_duration": 0.5})


def offered_load(jobs: DataFrame, capacity: int) -> DataFrame:
    day = jobs.groupBy(idiv("submit_t", DAY).alias("day")).agg((F.sum(F.col("duration") * F.col("gpu_num")) / (capacity * 86400.0)).alias("load"))
    q = F.percentile("load", F.array(F.lit(0.5), F.lit(0.95)))
    return day.agg(F.count("*").alias("days"), q[0].alias("median_load"), q[1].alias("p95_load"), F.max("load").alias("max_load"))
