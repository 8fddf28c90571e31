"""Reproducible samples by integer hashing; exact sizes without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import idiv, mix_hash
from ..session import materialize

BUCKETS = 4096
_BUCKET_WIDTH = (2_147_483_647 // BUCKETS) + 1


def exact_n(df: DataFrame, group: list[str], n: Column, keys: list[str], seed: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash (ties by key).

    Rows are counted per hash bucket first. Buckets wholly below the target pass
    as they are, and only the bucket that crosses it is ranked, so the largest
    group never becomes one sorted partition. ``n`` is an expression over group
    columns that are constant within a group.
    """
    d = df.withColumn("_h", mix_hash(seed, *keys)).withColumn("_n", n)
    d = d.withColumn("_b", idiv("_h", _BUCKET_WIDTH))
    per = d.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    d = d.join(per, [*group, "_b"]).where(F.col("_before") < F.col("_n"))
    r = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", *keys))
    d = d.withColumn("_r", F.when(F.col("_before") + F.col("_c") > F.col("_n"), r).otherwise(0))
    return d.where(F.col("_before") + F.col("_r") <= F.col("_n")).drop("_h", "_n", "_b", "_c", "_before", "_r")


def sample_negatives(df: DataFrame, segment: list[str], label: str, ratio: float, cap: int, keys: list[str], seed: int) -> DataFrame:
    """All positives plus ``min(cap, ratio * positives)`` negatives per segment."""
    if not segment:
        return _sample_whole(df, label, ratio, cap, keys, seed)
    pos = df.groupBy(*segment).agg(F.sum(label).alias("_p"))
    # A row a segment, written so that its size is known: else all rows are shuffled by the few segments.
    d = df.join(materialize(pos, "positives"), segment)
    target = F.least(F.lit(cap), F.floor(F.col("_p") * F.lit(float(ratio)))).cast("bigint")
    neg = exact_n(d.where(F.col(label) == 0), segment, target, keys, seed)
    return d.where(F.col(label) == 1).unionByName(neg).drop("_p")


def _sample_whole(df: DataFrame, label: str, ratio: float, cap: int, keys: list[str], seed: int) -> DataFrame:
    """``sample_negatives`` of one segment as a filter: the rows do not move, however wide they are.

    The last negative of the sample is looked up first, by a count per hash bucket and the order of the one
    bucket that holds it; the negatives up to it are the ``n`` smallest.
    """
    d, none = df.withColumn("_h", mix_hash(seed, *keys)), F.col(label) == 0
    per = d.groupBy(idiv("_h", _BUCKET_WIDTH).alias("_b")).agg(F.sum(label).alias("p"), F.count_if(none).alias("c")).where("_b IS NOT NULL OR p > 0").collect()
    room = min(cap, math.floor(sum(r["p"] or 0 for r in per) * float(ratio)))
    upto = F.col("_h").isNotNull()
    for r in sorted((r for r in per if r["_b"] is not None), key=lambda r: r["_b"]):
        if r["c"] > room:
            upto = F.col("_h") < r["_b"] * _BUCKET_WIDTH
            if room:
                last = d.where(none & (idiv("_h", _BUCKET_WIDTH) == r["_b"])).select(F.struct("_h", *keys).alias("_at")).orderBy("_at").offset(room - 1).limit(1)
                at = last.first()["_at"]
                upto = F.col("_h").isNotNull() & (F.struct("_h", *keys) <= F.struct(*[F.lit(at[c]).cast(last.schema["_at"].dataType[c].dataType).alias(c) for c in ("_h", *keys)]))
            break
        room -= r["c"]
    return d.where((F.col(label) == 1) | (none & upto)).drop("_h")


def thin_positives(onset_bins: DataFrame, h: int, stride: int) -> DataFrame:
    """Every ``stride``-th bin of each positive interval, distinct."""
    return onset_bins.select("entity", F.explode(F.sequence(F.col("bin") - h, F.col("bin"), F.lit(stride))).alias("bin")).distinct()


def validation_subset(df: DataFrame, label: str, budget: int, keys: list[str], seed: int) -> DataFrame:
    """All positives, negatives up to ``budget`` rows in all.

    The budget bounds evaluation rows, a feature of this operator: metrics on the subset see a
    higher prevalence. ``left_out`` is the number of negatives that are not in it.
    """
    n = df.agg(F.sum(label).alias("p"), F.count_if(F.col(label) == 0).alias("n")).select(F.struct("p", "n")).scalar()
    room = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(n["p"], F.lit(0)))
    d = df.withColumns({"_p": room, "left_out": F.greatest(F.lit(0), n["n"] - room)})
    neg = exact_n(d.where(F.col(label) == 0), [], F.col("_p"), keys, seed)
    return d.where(F.col(label) == 1).unionByName(neg).drop("_p")


def sample_times(times: DataFrame, t: str, n: int, seed: int) -> DataFrame:
    return exact_n(times.select(t).distinct(), [], F.lit(n), [t], seed)


def sample_multi(df: DataFrame, heads: list[str], ratio: float, cap: int, keys: list[str], seed: int) -> DataFrame:
    """Rows positive in any head, and sampled rows with none."""
    any_ = F.greatest(*heads)
    return sample_negatives(df.withColumn("_any", any_), [], "_any", ratio, cap, keys, seed).drop("_any")


def sample_summary(df: DataFrame, label: str, eligible: str) -> DataFrame:
    y = F.when(F.col(eligible), F.col(label))
    return df.agg(F.count("*").alias("rows"), F.count_if(eligible).alias("eligible"), (F.count("*") - F.count_if(eligible)).alias("censored"),
                  F.coalesce(F.sum(y), F.lit(0)).alias("positives"), F.avg(y).alias("prevalence"))


def class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``n / (2 * n_class)`` from one aggregate row."""
    c = df.agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    n, p = c.select("n").scalar(), c.select("p").scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p))))


def case_control_weight(sample: DataFrame, population: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Negatives stand for all negatives: ``total / sampled``."""
    total = population.agg(F.count_if(F.col(label) == 0)).scalar()
    drawn = sample.agg(F.count_if(F.col(label) == 0)).scalar()
    return sample.withColumn(name, F.when(F.col(label) == 1, F.lit(1.0)).otherwise(total / drawn))


def priors(df: DataFrame, sample: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """Natural share over the span and share in the sample."""
    a = df.groupBy(*group).agg(F.avg(label).alias("true_prior"))
    b = sample.groupBy(*group).agg(F.avg(label).alias("sample_prior"), F.count("*").alias("samples"))
    return a.join(b, group)


def standardize(df: DataFrame, train: Column, cols: list[str], suffix: str = "_z") -> DataFrame:
    """Mean and population std of the training rows; tiny scales become 1, NULL the mean."""
    a = df.where(train).agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    out = {}
    for c in cols:
        m, s = a.select(f"m_{c}").scalar(), a.select(f"s_{c}").scalar()
        out[f"{c}{suffix}"] = (F.coalesce(F.col(c), m) - m) / F.when(s < 1e-6, F.lit(1.0)).otherwise(s)
    return df.withColumns(out)


def impute_median(df: DataFrame, train: Column, cols: list[str]) -> DataFrame:
    """NULL becomes the training median (training rows only, so nothing leaks)."""
    from .summaries import exact_percentiles

    return df.withColumns({c: F.coalesce(F.col(c), exact_percentiles(df.where(train), [], c, {"m": 0.5}).select("m").scalar()) for c in cols})
