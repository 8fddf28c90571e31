"""Distribution and missingness summaries; quantiles that survive a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import score_chunk
from .scan import running


def exact_percentiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per name.

    ``percentile`` keeps every distinct value of a group in one task. Here values
    are first counted per (key, value), the counts are accumulated by a two-level
    scan over value chunks, and each quantile is the interpolation between the two
    values whose cumulative counts straddle its position.
    """
    h = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    n = h.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    cum = running(h, keys, ["_x"], score_chunk("_x"), {"_cum": ("sum", F.col("_c"))})
    if keys:
        cum = cum.withColumn("_key", F.struct(*keys)).join(n.select(F.struct(*keys).alias("_key"), "_n"), "_key")
    else:
        cum = cum.withColumn("_n", n.scalar())
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_x"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_x"))).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr_{name}")]
    a = cum.groupBy(*keys).agg(*aggs)
    return a.select(*keys, *[(F.col(f"_lo_{q}") + F.col(f"_fr_{q}") * (F.col(f"_hi_{q}") - F.col(f"_lo_{q}"))).alias(q) for q in probs])


def with_percentiles(agg: DataFrame, df: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Add quantile columns to an aggregate of the same keys."""
    q = exact_percentiles(df, keys, x, probs)
    if keys:  # struct keys: the NULL key keeps its quantiles
        q = q.select(F.struct(*keys).alias("_key"), *probs)
        return agg.withColumn("_key", F.struct(*keys)).join(q, "_key", "left").drop("_key")
    row = q.select(F.struct(*probs)).scalar()
    return agg.withColumns({p: row[p] for p in probs})


def entity_summary(df: DataFrame, key: str, x: str) -> DataFrame:
    """Counts, missing and zero rates, mean, population std, quantiles."""
    n = F.count(x)
    a = df.groupBy(key).agg(
        F.count("*").alias("samples"), n.alias("valid"), (1 - n / F.count("*")).alias("missing_rate"),
        (F.count_if(F.col(x) == 0) / n).alias("zero_rate"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    return with_percentiles(a, df, [key], x, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def time_summary(df: DataFrame, t: str, x: str) -> DataFrame:
    a = df.groupBy(t).agg(F.count(x).alias("observed"), F.avg(x).alias("mean"))
    return with_percentiles(a, df, [t], x, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def missingness(df: DataFrame, key: str, x: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col(x).isNull()).alias("missing"),
                               (F.count_if(F.col(x).isNull()) / F.count("*")).alias("missing_rate"))
