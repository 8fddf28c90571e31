"""Time bins, dense grids, integrity checks and per-bin aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import bin_index


def bin_means(df: DataFrame, keys: list[str], t: str, t0: int, step: int, metrics) -> DataFrame:
    """Tumbling mean and valid count per metric; partial aggregation absorbs hot keys."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_n")]
    return df.groupBy(*keys, bin_index(t, t0, step).alias("bin")).agg(*aggs)


def bin_std(df: DataFrame, keys: list[str], t: str, t0: int, step: int, metric: str) -> DataFrame:
    """Population std per bin from raw rows."""
    return df.groupBy(*keys, bin_index(t, t0, step).alias("bin")).agg(
        F.stddev_pop(metric).alias(f"{metric}_std"), F.count(metric).alias(f"{metric}_n")
    )


def densify(df: DataFrame, key: list[str], attrs: list[str], lo: Column, hi: Column, bin_col: str = "bin") -> DataFrame:
    """Every key gets every bin of ``[lo, hi]``; missing cells are NULL rows.

    Each row lists the bins up to the key's next row (the first row also those
    from ``lo``), so there is no join and no cross product: one pass, partitioned
    by ``key`` as the windows downstream need it. ``attrs`` belong to the key.
    """
    w = Window.partitionBy(*key).orderBy(bin_col)
    values = [c for c in df.columns if c not in (*key, *attrs, bin_col)]
    start = F.when(F.lag(bin_col).over(w).isNull(), lo).otherwise(F.col(bin_col))
    end = F.coalesce(F.lead(bin_col).over(w) - 1, hi)
    d = df.withColumns({"_from": start, "_to": end})
    d = d.withColumn("_b", F.explode(F.sequence("_from", "_to")))
    here = F.col("_b") == F.col(bin_col)
    return d.select(*key, *attrs, F.col("_b").alias(bin_col), *[F.when(here, F.col(c)).alias(c) for c in values])


def fill_counts(df: DataFrame, metrics) -> DataFrame:
    return df.fillna(0, subset=[f"{m}_n" for m in metrics])


def assemble_metrics(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Long metric frames (``keys, value``) side by side; one shuffle for all metrics.

    ``<m>_absent`` marks a missing value; a key absent from every frame has no row.
    """
    parts = [f.select(*keys, F.lit(m).alias("_m"), F.col("value")) for m, f in frames.items()]
    u = reduce(DataFrame.unionByName, parts)
    wide = u.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_m") == m, F.col("value"))).alias(m) for m in frames],
        *[F.max(F.when(F.col("_m") == m, 1).otherwise(0)).alias(f"_{m}_row") for m in frames],
    )
    return wide.select(
        *keys, *frames,
        *[F.when(F.col(m).isNull(), 1).otherwise(0).cast("bigint").alias(f"{m}_value_absent") for m in frames],
        *[(1 - F.col(f"_{m}_row")).cast("bigint").alias(f"{m}_row_absent") for m in frames],
    )


def group_mean(df: DataFrame, group: list[str], cols: dict[str, str]) -> DataFrame:
    """Mean of the valid members per (group, bin), NULL if there is none."""
    return df.groupBy(*group).agg(*[F.avg(c).alias(o) for o, c in cols.items()])


def with_group_mean(df: DataFrame, group: list[str], cols: dict[str, str]) -> DataFrame:
    """Each member also sees its group's mean at the same bin.

    Aggregate and join back: the aggregate combines map-side, so a group that
    holds a large share of all members does not become one window task.
    """
    return df.join(group_mean(df, group, cols), group, "left")


def min_coverage(df: DataFrame, counts: list[str], name: str = "min_n") -> DataFrame:
    return df.withColumn(name, F.least(*counts))


def sample_every(df: DataFrame, bin_col: str, k: int) -> DataFrame:
    return df.where(F.pmod(F.col(bin_col), F.lit(k)) == 0)


def contiguous_history(df: DataFrame, keys: list[str], bin_col: str, n: int, name: str = "contiguous") -> DataFrame:
    """True when the row ``n`` places earlier lies exactly ``n`` bins back."""
    w = Window.partitionBy(*keys).orderBy(bin_col)
    return df.withColumn(name, F.coalesce(F.col(bin_col) - F.lag(bin_col, n).over(w) == F.lit(n), F.lit(False)))


def grid_violations(df: DataFrame, entity: str, group: str, slot: str, bin_col: str, lo: Column, hi: Column,
                    members: int) -> DataFrame:
    """One row per rule with the number of violations."""
    keys = df.groupBy(entity, bin_col).agg(F.count("*").alias("n"))
    dup = keys.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("violations")).select(F.lit("duplicate_key").alias("rule"), "violations")
    off = df.agg(F.count_if((F.col(bin_col) < lo) | (F.col(bin_col) > hi)).alias("violations")).select(
        F.lit("off_grid").alias("rule"), "violations")
    ids = df.select(entity, group, slot).distinct()
    per_group = ids.groupBy(group).agg(F.count("*").alias("m"), F.count_distinct(slot).alias("s"),
                                       F.min(slot).alias("lo_s"), F.max(slot).alias("hi_s"))
    wrong = per_group.agg(F.count_if((F.col("m") != members) | (F.col("s") != members) | (F.col("lo_s") != 0)
                                     | (F.col("hi_s") != members - 1)).alias("violations")).select(
        F.lit("incomplete_group").alias("rule"), "violations")
    amb = ids.groupBy(entity).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(
        F.lit("entity_in_two_groups").alias("rule"), "violations")
    return dup.union(off).union(wrong).union(amb)


def coverage_violations(df: DataFrame, valid: str, expected: str) -> DataFrame:
    return df.where(F.col(valid) > F.col(expected))
