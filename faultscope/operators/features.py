"""Leakage-safe feature sets on the dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import DAY, HOUR, MINUTE, clean, day_of_week, hour_of_day, is_weekend, safe_ratio
from ..session import dealt
from . import windows as W
from .joins import asof, event_counts

METRICS = ("util", "temp", "power", "fb")
CONTEXT = ("util", "temp", "power")
KEYS = ["entity"]
ID = ["entity", "grp", "slot", "bin"]


def _levels(grid: DataFrame) -> DataFrame:
    return grid.select(*ID, *[F.col(f"{m}_mean").alias(m) for m in METRICS])


def _lagged_context(df: DataFrame, gap: int, keys: list[str] = KEYS) -> DataFrame:
    """Group mean at the exact lag bin and the member's distance to it."""
    g = Window.partitionBy("grp", "bin")
    d = df.withColumns({f"_g_{m}": F.avg(m).over(g) for m in CONTEXT})
    w = Window.partitionBy(*keys).orderBy("bin")
    return d.withColumns({f"{m}_node_mean": F.lag(f"_g_{m}", gap).over(w) for m in CONTEXT}).drop(*[f"_g_{m}" for m in CONTEXT])


def with_node_diff(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{m}_diff_node": F.col(f"{m}_last") - F.col(f"{m}_node_mean") for m in CONTEXT})


def zero_filled(df: DataFrame) -> DataFrame:
    """Missing last, mean and group mean become 0 before the differences (the frozen and the integrated layout)."""
    c, zero = F.col, lambda n: F.coalesce(F.col(n), F.lit(0.0))
    d = df.withColumns({f"{m}_{s}": zero(f"{m}_{s}") for m in METRICS for s in ("last", "mean")} | {f"{m}_node_mean": zero(f"{m}_node_mean") for m in CONTEXT})
    return d.withColumns({f"{m}_delta": c(f"{m}_last") - c(f"{m}_mean") for m in METRICS})


def basic30(grid: DataFrame, w: int, gap: int = 3, zero_last: bool = False, colocate: bool = False) -> DataFrame:
    """Six window statistics of four metrics, group mean and distance for three.

    ``zero_last`` keeps rows with full history only and fills missing values with 0 first;
    ``colocate`` as in ``peer45``.
    """
    ent = ["grp", "entity"] if colocate else KEYS
    d = _lagged_context(dealt(_levels(grid), "grp") if colocate else _levels(grid), gap, ent)
    if zero_last:
        d = d.withColumn("has_history", W.has_history(ent, w, gap))
    d = W.lag_window(d, ent, METRICS, w, gap, tag="")
    d = with_node_diff(zero_filled(d.where("has_history")) if zero_last else d)
    cols = [f"{m}_{s}" for m in METRICS for s in ("last", "mean", "max", "min", "std", "delta")]
    cols += [f"{m}_{s}" for m in CONTEXT for s in ("node_mean", "diff_node")]
    return d.select(*ID, *cols)


def cross_metric(df: DataFrame, headroom: str = "max") -> DataFrame:
    """Seven interactions between metrics; headroom from the peak or the last value."""
    c = F.col
    return df.withColumns({
        "thermal_efficiency": safe_ratio("temp_mean", "util_mean"),
        "power_temp_ratio": safe_ratio("power_std", "temp_std"),
        "util_fb_coupling": c("util_delta") * c("fb_delta"),
        "power_per_util": safe_ratio("power_mean", "util_mean"),
        "temp_fb_divergence": F.abs(c("temp_delta") - c("fb_delta")),
        "thermal_headroom": c(f"temp_{headroom}") - c("temp_mean"),
        "power_headroom": c(f"power_{headroom}") - c("power_mean"),
    })


CROSS = ["thermal_efficiency", "power_temp_ratio", "util_fb_coupling", "power_per_util", "temp_fb_divergence",
         "thermal_headroom", "power_headroom"]


def dynamics(df: DataFrame, hours: float) -> DataFrame:
    h = max(float(hours), 1.0)
    return df.withColumns({
        "temp_slope": F.col("temp_delta") / h, "power_slope": F.col("power_delta") / h,
        "thermal_persistence": safe_ratio("temp_delta", "temp_std"),
    })


TOPOLOGY = ["temp_peer_max", "temp_peer_mean", "temp_peer_std", "temp_peer_diff", "power_peer_max", "power_peer_mean",
            "power_peer_diff", "util_peer_mean"]
RELATIVE = ["temp_peer_z", "power_peer_z", "util_peer_z", "temp_peer_rank", "power_peer_rank"]
DYNAMICS = ["temp_slope", "power_slope", "thermal_persistence"]


def peer45(grid: DataFrame, w: int, gap: int = 3, layout: str = "integrated", hours: float = 1.0,
           policy: str = "legacy", colocate: bool = False) -> DataFrame:
    """45 columns: 30+7+8 (``unified``) or 22+7+8+8 (``integrated``), cleaned to numbers.

    ``colocate`` shuffles once by group: both the entity windows and the group
    windows are then satisfied by that partitioning. Only for groups that passed
    the integrity check, since a group becomes one task's unit.
    """
    d = dealt(_levels(grid), "grp") if colocate else _levels(grid)
    ent = ["grp", "entity"] if colocate else ["entity"]
    g = ["grp", "bin"]
    gw = Window.partitionBy(*g)
    d = d.withColumns({f"_g_{m}": F.avg(m).over(gw) for m in CONTEXT})
    for m in CONTEXT:
        d = W.peer_stats(d, g, "slot", m, policy=policy)
    d = W.lag_window(d, ent, METRICS, w, gap, tag="")
    ew = Window.partitionBy(*ent).orderBy("bin")
    peers = TOPOLOGY + RELATIVE
    d = d.withColumns({f"{m}_node_mean": F.lag(f"_g_{m}", gap).over(ew) for m in CONTEXT}
                      | {p: F.lag(p, gap).over(ew) for p in peers}
                      | {"has_history": W.has_history(ent, w, gap)})
    d = d.where("has_history")
    if layout == "integrated":
        d = zero_filled(d)
    d = dynamics(cross_metric(with_node_diff(d)), hours)
    stats = ("last", "mean", "max", "min", "std", "delta") if layout == "unified" else ("last", "mean", "std", "delta")
    cols = [f"{m}_{s}" for m in METRICS for s in stats] + [f"{m}_{s}" for m in CONTEXT for s in ("node_mean", "diff_node")]
    cols += CROSS + TOPOLOGY + ([] if layout == "unified" else RELATIVE + DYNAMICS)
    return d.select(*ID, *[clean(c).alias(c) for c in cols])


def history5(decisions: DataFrame, onsets: DataFrame, buffer: int = 10 * MINUTE, cap_days: float = 90.0,
             calendar: bool = True, span: int = 30 * DAY, until=None) -> DataFrame:
    """Onsets of the last 30 days and days since the last one at ``t - buffer``, plus the calendar."""
    d = decisions.withColumn("_cut", F.col("t") - F.lit(buffer))
    d = event_counts(d, onsets, ["entity"], "_cut", "t", {"count_30d": span}, until=until)
    d = asof(d, onsets.select("entity", F.col("t").alias("_et")), ["entity"], "_cut", "_et", {"_last": "_et"}, until=until)
    d = d.withColumn("days_since", F.coalesce(F.least((F.col("_cut") - F.col("_last")) / DAY, F.lit(cap_days)), F.lit(cap_days)))
    if calendar:
        d = d.withColumns({"hour": hour_of_day("t"), "dow": day_of_week("t"), "weekend": is_weekend("t")})
    return d.drop("_cut", "_last")


def hazard11(decisions: DataFrame, onsets: DataFrame, start_t: int, buffer: int = 10 * MINUTE, until=None) -> DataFrame:
    """Counts over five spans, recency, last inter-arrival, exposure and rates."""
    from ..functions.scalar import idiv
    from .scan import with_neighbour

    spans = {"c_1h": HOUR, "c_6h": 6 * HOUR, "c_24h": DAY, "c_7d": 7 * DAY, "c_30d": 30 * DAY}
    d = decisions.withColumn("_cut", F.col("t") - F.lit(buffer))
    d = event_counts(d, onsets, ["entity"], "_cut", "t", spans, until=until)
    ev = with_neighbour(onsets.select("entity", F.col("t").alias("_et")), ["entity"], ["_et"], idiv("_et", 30 * DAY), {"_pt": "_et"})
    d = asof(d, ev, ["entity"], "_cut", "_et", {"_last": "_et", "_before": "_pt"}, until=until)
    expo = F.greatest(F.lit(0.0), F.least(F.lit(30.0), (F.col("_cut") - F.lit(start_t)) / DAY))
    cap = lambda x: F.coalesce(F.least(x / DAY, F.lit(90.0)), F.lit(90.0))
    return d.withColumns({
        "days_since": cap(F.col("_cut") - F.col("_last")),
        "has_past": F.when(F.col("_last").isNotNull(), 1).otherwise(0).cast("bigint"),
        "last_gap_days": cap(F.col("_last") - F.col("_before")),
        "share_1h": F.col("c_1h") / F.greatest(F.col("c_24h"), F.lit(1)),
        "exposure_days": expo, "rate_30d": F.col("c_30d") / F.greatest(expo, F.lit(1.0)),
    }).drop("_cut", "_last", "_before")


def dense_features(grid: DataFrame, spans: dict[str, int], gap: int, bin_hours: float) -> DataFrame:
    """Eleven statistics per metric and span of the in-window interpolated series."""
    d = dealt(grid.select(*ID, *[F.col(f"{m}_mean").alias(m) for m in METRICS], *[F.col(f"{m}_n").alias(f"{m}_obs") for m in METRICS]), *KEYS)
    d = W.filled_windows(d, KEYS, METRICS, [f"{m}_obs" for m in METRICS], spans, gap, bin_hours)
    names = ("last", "mean", "std", "delta", "slope", "valid", "missing", "stale")
    cols = [f"{m}_{s}_{t}" for t in spans for m in METRICS for s in names]
    cols += [c for t in spans for c in ([f"{m}_{s}_{t}" for m in METRICS for s in ("min", "max")] + [f"{m}_obs_{t}" for m in METRICS])]
    return d.select(*ID, *cols)


def context_features(grid: DataFrame, context: DataFrame, context_cols: list[str], w: int, gap: int) -> DataFrame:
    """Mean, std, last, min, max of the temporal channels; mean and last of context columns."""
    d = W.first_difference(_levels(grid), KEYS, METRICS)
    chan = [*METRICS, *[f"{m}_diff" for m in METRICS]]
    d = d.join(context, ["entity", "bin"], "left").fillna(0.0, subset=context_cols)
    d = W.lag_window(d, KEYS, chan, w, gap, tag="_c")
    f = W.frame(KEYS, w, gap)
    ok = W.has_history(KEYS, w, gap)
    ew = Window.partitionBy(*KEYS).orderBy("bin")
    d = d.withColumns({f"{c}_mean_x": F.when(ok, F.avg(c).over(f)) for c in context_cols}
                      | {f"{c}_last_x": F.when(ok, F.lag(c, gap).over(ew)) for c in context_cols})
    cols = [f"{c}_{s}_c" for c in chan for s in ("mean", "std", "last", "min", "max")]
    return d.select(*ID, *cols, *[f"{c}_{s}_x" for c in context_cols for s in ("mean", "last")])


def tape14(grid: DataFrame, decisions: DataFrame, onsets: DataFrame, w: int, gap: int = 3, until=None) -> DataFrame:
    """Last, mean, delta and group last for three metrics, count and days since (cap 95)."""
    b = basic30(grid, w, gap)
    h = history5(decisions.select("entity", "bin", "t"), onsets, cap_days=95.0, calendar=False, until=until)
    cols = [f"{m}_{s}" for m in CONTEXT for s in ("last", "mean", "delta", "node_mean")]
    return b.select(*ID, *cols).join(h, ["entity", "bin"])
