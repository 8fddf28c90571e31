"""Branch fusion, event-count weights and past-only score inertia."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import HOUR, expit, fuse, idiv, inertia_blend, logit, pareto_weight


def pareto_alpha(counts: DataFrame, k: str = "k", group: list[str] | None = None, minimum: int = 5) -> DataFrame:
    """Shape MLE over entities with at least one event; 1.0 below ``minimum`` of them."""
    pos = F.when(F.col(k) > 0, F.col(k))
    return counts.groupBy(*(group or [])).agg(
        F.when(F.count(pos) < minimum, F.lit(1.0)).otherwise(F.count(pos) / F.sum(F.log(pos + 1.0))).alias("alpha"),
        F.count(pos).alias("entities"))


def weighted_fusion(df: DataFrame, alpha: float | Column = 1.0, cap: float = 0.6, p1: str = "p1", p2: str = "p2", k: str = "k", floor=None) -> DataFrame:
    return df.withColumn("weight", pareto_weight(k, alpha, cap, floor)).withColumn("fused", fuse(p1, p2, F.col("weight")))


def ema_memory(df: DataFrame, keys: list[str], t: str, value: str, half_life_hours: float, reset_us: int | None = None,
               name: str = "memory", chunk_half_lives: int = 128) -> DataFrame:
    """Past-only exponential memory ``m_t = rho*m_{t-1} + (1-rho)*z_t`` with ``rho = 2^(-dt/h)``.

    ``name`` is the memory *before* the row; it is NULL on the first row of a
    segment, whose value seeds the memory. A gap of ``reset_us`` or more starts a
    new segment.

    The recursion is a chain of affine maps, so it is evaluated as running sums
    of ``z * 2^(t/h)`` inside chunks of ``chunk_half_lives`` half-lives (far from
    overflow), and the few chunk maps per key are composed with a fold. A key is
    never collected into one array.
    """
    from .scan import segments

    h = half_life_hours * HOUR
    width = max(1, int(h * chunk_half_lives))
    seg = "_seg"
    cols = [*keys, t, value]
    d = df
    if reset_us is None:
        d = d.withColumn(seg, F.lit(1).cast("bigint"))
        part = [*keys]
        chunk = idiv(t, width)
        d = d.withColumn("_chunk", chunk)
    else:
        narrow = d.select(*cols)
        s = segments(narrow, keys, [t], idiv(t, width), lambda p, c: c[t] - p[t] >= reset_us, seg).select(*keys, t, seg)
        s = s.select(F.struct(*keys).alias("_key"), t, seg)
        d = d.withColumn("_key", F.struct(*keys)).join(s, ["_key", t]).drop("_key")
        part = [*keys, seg]
        d = d.withColumn("_chunk", idiv(t, width))
    w = Window.partitionBy(*part, "_chunk").orderBy(t)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rel = lambda c: (c - F.col("_chunk") * F.lit(width)) / F.lit(h)
    z = F.col(value)
    # rho of the step into this row; the first row of the chunk gets its from the carry.
    d = d.withColumn("_pt", F.lag(t).over(w))
    rho = F.pow(F.lit(2.0), -(F.col(t) - F.col("_pt")) / F.lit(h))
    d = d.withColumn("_u", F.when(F.col("_pt").isNull(), F.lit(0.0)).otherwise((1 - rho) * z * F.pow(F.lit(2.0), rel(F.col(t)))))
    d = d.withColumn("_acc", F.sum("_u").over(upto))
    first_t = F.first(t).over(w)
    d = d.withColumns({"_ft": first_t, "_fz": F.first(value).over(w), "_pacc": F.lag("_acc").over(w)})
    # Inside a chunk: m_after(t) = acc(t)*2^-rel(t) + m_first * 2^-(t - t_first)/h.
    ends = d.groupBy(*part, "_chunk").agg(
        F.min(t).alias("ft"), F.max(t).alias("lt"), F.max_by("_acc", t).alias("acc"), F.min_by(value, t).alias("fz"))
    one = F.struct("_chunk", "ft", "lt", F.col("acc"), "fz")
    folded = ends.groupBy(*part).agg(F.array_sort(F.collect_list(one)).alias("a"))
    two = lambda e: F.pow(F.lit(2.0), e)

    def step(acc, x):
        dt = (x["ft"] - acc["lt"]) / F.lit(h)
        before = acc["m"]
        mf = F.when(acc["m"].isNull(), x["fz"]).otherwise(two(-dt) * acc["m"] + (1 - two(-dt)) * x["fz"])
        after = x["acc"] * two(-((x["lt"] - x["_chunk"] * F.lit(width)) / F.lit(h))) + mf * two(-((x["lt"] - x["ft"]) / F.lit(h)))
        return F.struct(after.alias("m"), x["lt"].alias("lt"),
                        F.concat(acc["out"], F.array(F.struct(x["_chunk"].alias("_chunk"), before.alias("before"), mf.alias("mf")))).alias("out"))

    empty = F.expr("cast(array() as array<struct<_chunk:bigint,before:double,mf:double>>)")
    zero = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0).cast("bigint").alias("lt"), empty.alias("out"))
    carry = folded.select(*part, F.explode(F.aggregate("a", zero, step, lambda s: s["out"])).alias("o")).select(
        *part, F.col("o._chunk").alias("_chunk"), F.col("o.before").alias("_before"), F.col("o.mf").alias("_mf"))
    d = d.join(carry.withColumnsRenamed({k: f"_r_{k}" for k in (*part, "_chunk")}), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in (*part, "_chunk")]))
    mem = F.when(F.col("_pt").isNull(), F.col("_before")).otherwise(
        F.col("_pacc") * two(-rel(F.col("_pt"))) + F.col("_mf") * two(-((F.col("_pt") - F.col("_ft")) / F.lit(h))))
    return d.select(*[F.col(c) for c in df.columns], mem.alias(name))


def inertia(df: DataFrame, t: str, p: str, half_life_hours: float, gamma: float, keys=("entity",), reset_us=None, name="q") -> DataFrame:
    """Logit-space blend of the score with its past memory; the first row is unchanged."""
    d = df.withColumn("_z", logit(p))
    d = ema_memory(d, list(keys), t, "_z", half_life_hours, reset_us, "_mem")
    q = expit(F.when(F.col("_mem").isNull(), F.col("_z")).otherwise(inertia_blend("_z", "_mem", gamma)))
    return d.withColumn(name, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), q))).drop("_z", "_mem")


def hold_scores(coarse: DataFrame, fine_times: DataFrame, keys=("entity",), t: str = "t", score: str = "score", width: int = 24 * HOUR) -> DataFrame:
    """The last coarse score at or before each fine time; never a future one."""
    from .joins import asof

    return asof(fine_times, coarse.select(*keys, F.col(t).alias("_ct"), score), list(keys), t, "_ct", {score: score}, width)

