"""Adaptive controllers as folds over the ordered block table.

One row per scoring block (origin); the table grows with the number of days, not
with the data, so a fold over its ordered array is bounded by the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _rows(order: str, a: int, b: int, by=()):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(a, b) if by else Window.orderBy(order).rowsBetween(a, b)


def recent_drop(blocks: DataFrame, value: str, order: str = "origin", name: str = "drop", by=()) -> DataFrame:
    """Relative fall of the mean of the last three plus current against the three before."""
    recent = F.avg(value).over(_rows(order, -3, 0, by))
    prior = F.avg(value).over(_rows(order, -6, -4, by))
    drop = F.greatest(F.lit(0.0), (prior - recent) / F.greatest(F.abs(prior), F.lit(1e-4)))
    return blocks.withColumn(name, F.when(prior.isNull(), F.lit(0.0)).otherwise(drop))


def branch_reliability(blocks: DataFrame, value: str, name: str, order: str = "origin", window: int = 3) -> DataFrame:
    """0.6 * recent mean + 0.3 * stability + 0.1 * (1 - drop), clipped to [0, 1]."""
    cur, old = _rows(order, -(window - 1), 0), _rows(order, -(2 * window - 1), -window)
    mean = F.avg(value).over(cur)
    stab = 1 / (1 + F.stddev_pop(value).over(cur) / F.greatest(F.abs(mean), F.lit(1e-4)))
    pm = F.avg(value).over(old)
    drop = F.when(pm.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (pm - mean) / F.greatest(F.abs(pm), F.lit(1e-4))))
    d = blocks.withColumns({f"{name}_stability": stab, f"{name}_drop": drop, "_mean": mean})
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("_mean") + 0.3 * F.col(f"{name}_stability") + 0.1 * (1 - F.col(f"{name}_drop"))))
    return d.withColumn(f"{name}_reliability", rel).drop("_mean")


def recent_context(blocks: DataFrame, cols: list[str], n: int = 48, order: str = "origin") -> DataFrame:
    return blocks.withColumns({f"{c}_recent": F.avg(c).over(_rows(order, -(n - 1), 0)) for c in cols})


def ordered_fold(blocks: DataFrame, order: str, cols: list[str], zero: Column, step) -> DataFrame:
    """Fold over the ordered block array inside the engine; ``step(state, row)`` returns the next state.

    Every state is kept: one output row per block with the state after it.
    """
    row = F.struct(order, *cols)
    arr = blocks.agg(F.array_sort(F.collect_list(row)).alias("a"))
    init = F.struct(zero.alias("s"), F.array_repeat(F.struct(F.lit(0).cast("bigint").alias(order), zero.alias("s")), 0).alias("out"))

    def go(acc, x):
        nxt = step(acc["s"], x)
        return F.struct(nxt.alias("s"), F.concat(acc["out"], F.array(F.struct(x[order].cast("bigint").alias(order), nxt.alias("s")))).alias("out"))

    return arr.select(F.explode(F.aggregate("a", init, go, lambda s: s["out"])).alias("o")).select(F.col(f"o.{order}").alias(order), "o.s.*")


def window_controller(blocks: DataFrame, value: str, order: str = "origin", drop_limit: float = 0.15, stable_needed: int = 3) -> DataFrame:
    """Training length 21 > 14 > 7 days: shrink on a drop, grow after stable blocks; starts at 14."""
    d = recent_drop(blocks.select(order, value), value, order)
    days = F.array(F.lit(7), F.lit(14), F.lit(21))
    zero = F.struct(F.lit(1).alias("idx"), F.lit(0).alias("stable"), F.lit("start").alias("action"))

    def step(s, x):
        falls = x["drop"] >= drop_limit
        grows = ~falls & (s["stable"] + 1 >= stable_needed) & (s["idx"] < 2)
        idx = F.when(falls & (s["idx"] > 0), s["idx"] - 1).when(grows, s["idx"] + 1).otherwise(s["idx"])
        stable = F.when(falls | grows, F.lit(0)).otherwise(s["stable"] + 1)
        action = F.when(falls & (s["idx"] > 0), "shrink").when(falls, "hold_min").when(grows, "expand").otherwise("hold")
        return F.struct(idx.alias("idx"), stable.alias("stable"), action.alias("action"))

    f = ordered_fold(d, order, ["drop"], zero, step)
    return f.select(order, F.element_at(days, F.col("idx") + 1).alias("next_days"), "stable", "action")


def reliability_gate(blocks: DataFrame, b1: str, b2: str, order: str = "origin", lo: float = 0.2, hi: float = 0.8, max_step: float = 0.1,
                     scale: float = 0.2, margin: float = 0.03, drift: float = 0.2, hysteresis: int = 2) -> DataFrame:
    """Branch-1 weight for the next block from reliabilities, with hysteresis and drift override."""
    d = branch_reliability(branch_reliability(blocks.select(order, b1, b2), b1, "r1", order), b2, "r2", order)
    delta = F.col("r1_reliability") - F.col("r2_reliability")
    d1 = (F.col("r1_drop") >= drift) & (F.col("r1_drop") > F.col("r2_drop"))
    d2 = (F.col("r2_drop") >= drift) & (F.col("r2_drop") > F.col("r1_drop"))
    direction = F.when(d1, -1).when(d2, 1).when(delta >= margin, 1).when(delta <= -margin, -1).otherwise(0)
    d = d.withColumns({"conf": F.least(F.lit(1.0), F.abs(delta) / scale), "dir": direction,
                       "drifted": F.when(d1, -1).when(d2, 1).otherwise(0)})
    zero = F.struct(F.lit(0.5).alias("weight"), F.lit(0).alias("pending"), F.lit(0).alias("streak"))

    def step(s, x):
        streak = F.when(x["dir"] == 0, F.lit(0)).when(x["dir"] == s["pending"], s["streak"] + 1).otherwise(F.lit(1))
        confirmed = (streak >= hysteresis) | (x["drifted"] != 0)
        target = (F.when(x["dir"] == 0, F.lit(0.5)).when(~confirmed, s["weight"]).when(x["drifted"] == -1, F.lit(lo))
                  .when(x["drifted"] == 1, F.lit(hi)).otherwise(0.5 + x["dir"] * 0.3 * x["conf"]))
        target = F.greatest(F.lit(lo), F.least(F.lit(hi), target))
        move = F.greatest(F.lit(-max_step), F.least(F.lit(max_step), target - s["weight"]))
        w = F.greatest(F.lit(lo), F.least(F.lit(hi), s["weight"] + move))
        return F.struct(w.alias("weight"), x["dir"].alias("pending"), streak.alias("streak"))

    f = ordered_fold(d, order, ["dir", "conf", "drifted"], zero, step)
    return f.select(order, F.col("weight").alias("next_weight_b1"), F.col("pending").alias("direction"), "streak")


def matured_feedback(blocks: DataFrame, origin_df: DataFrame, purge: int, horizon: int) -> DataFrame:
    """First origin at which each block's feedback may be applied.

    Applied when its last score lies a purge before the origin and its labels are
    complete at the origin. The first such origin is an as-of lookup.
    """
    from .joins import asof

    ready = blocks.withColumn("_ready", F.col("latest_score_bin") + F.greatest(F.lit(purge), F.lit(horizon)))
    o = origin_df.select(F.col("origin").alias("apply_at"))
    return asof(ready, o, [], "_ready", "apply_at", {"applied_at_origin": "apply_at"}, width=4096, forward=True).drop("_ready")


def momentum_zero() -> Column:
    """State before the first cycle."""
    return F.struct(
        F.lit(None).cast("bigint").alias("days"), F.lit(None).cast("bigint").alias("hours"), F.lit(0.0).alias("score"), F.lit(0).alias("same"),
        F.lit(0.0).alias("conf"), F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("h"), F.lit(0.0).alias("c")), 0).alias("book"),
        F.lit("start").alias("action"))


def momentum_step(beta: float = 0.7, threshold: float = 0.65, cooldown: int = 2, drop_limit: float = 0.15, short_gain: float = 0.05):
    """``step(state, row)`` of the hold-or-search control; ``row`` has the scores of all settings."""
    def step(s, x):
        has = s["days"].isNotNull()
        can = has & (s["same"] >= cooldown) & (s["conf"] >= threshold)
        quick = F.aggregate(x["scores"], F.lit(0.0), lambda a, r: F.when((r["days"] == s["days"]) & (r["hours"] == s["hours"]), r["ap"]).otherwise(a))
        keep = can & ((s["score"] - quick) / F.greatest(s["score"], F.lit(1e-9)) <= drop_limit)
        allowed = F.filter(x["scores"], lambda r: ~has | (r["days"] >= s["days"]) | ((r["ap"] - s["score"]) / F.greatest(s["score"], F.lit(1e-9)) >= short_gain))
        none = F.struct(F.lit(14).cast("bigint").alias("days"), F.lit(6).cast("bigint").alias("hours"), F.lit(float("-inf")).alias("ap"))
        best = F.aggregate(allowed, none, lambda a, r: F.when(r["ap"] > a["ap"], F.struct(r["days"].alias("days"), r["hours"].alias("hours"), r["ap"].alias("ap"))).otherwise(a))
        days, hours = F.when(keep, s["days"]).otherwise(best["days"]), F.when(keep, s["hours"]).otherwise(best["hours"])
        score = F.when(keep, quick).otherwise(best["ap"])
        old = F.aggregate(s["book"], F.lit(0.0), lambda a, r: F.when((r["d"] == days) & (r["h"] == hours), r["c"]).otherwise(a))
        book = F.transform(F.filter(s["book"], lambda r: ~((r["d"] == days) & (r["h"] == hours))),
                           lambda r: F.struct(r["d"].alias("d"), r["h"].alias("h"), (r["c"] * beta).alias("c")))
        conf = beta * old + (1 - beta)
        book = F.concat(book, F.array(F.struct(days.alias("d"), hours.alias("h"), conf.alias("c"))))
        same = F.when(has & (days == s["days"]) & (hours == s["hours"]), s["same"] + 1).otherwise(F.lit(1))
        action = F.when(keep, "hold").when(can, "rescan").when(has & (s["conf"] < threshold), "low_confidence").otherwise("search")
        return F.struct(days.alias("days"), hours.alias("hours"), score.alias("score"), same.alias("same"), conf.alias("conf"), book.alias("book"), action.alias("action"))

    return step


def momentum(cycles: DataFrame, order: str = "origin", beta: float = 0.7, threshold: float = 0.65, cooldown: int = 2, drop_limit: float = 0.15,
             short_gain: float = 0.05) -> DataFrame:
    """Hold or re-search a window combination per cycle.

    ``cycles``: ``order`` and ``scores: array<struct<days, hours, ap>>`` in grid
    order (validation AP of every combination). Holding needs ``cooldown`` equal
    choices and a confidence of ``threshold``, and the held combination's AP may
    fall by at most ``drop_limit``. In a search a shorter training length must
    gain ``short_gain`` over the previous score; the first maximum wins.
    """
    return ordered_fold(cycles, order, ["scores"], momentum_zero(), momentum_step(beta, threshold, cooldown, drop_limit, short_gain)).drop("book")


def robust_ap(blocks: DataFrame, ap: str, minutes: str) -> DataFrame:
    """Equal-block and time-weighted means, and means over blocks of at least 30 min, 12 h, 24 h."""
    def atleast(m):
        return F.avg(F.when(F.col(minutes) >= m, F.col(ap)))

    return blocks.agg(F.avg(ap).alias("equal_block"), (F.sum(F.col(ap) * F.col(minutes)) / F.sum(minutes)).alias("time_weighted"),
                      atleast(30).alias("min_30m"), atleast(720).alias("min_12h"), atleast(1440).alias("min_24h"))


def contrast(metrics: DataFrame, arm: str, keys: list[str], value: str, a: str, b: str, tol: float = 1e-12) -> DataFrame:
    """Paired contrast of two arms: difference, relative change, wins, ties, losses, median."""
    w = metrics.where(F.col(arm).isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col(arm) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("_b"))
    w = w.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).withColumn("_d", F.col("_a") - F.col("_b"))
    return w.agg(F.count("*").alias("blocks"), F.avg("_d").alias("difference"), (100 * F.avg("_d") / F.avg("_b")).alias("relative_pct"),
                 F.count_if(F.col("_d") > tol).alias("wins"), F.count_if(F.abs("_d") <= tol).alias("ties"), F.count_if(F.col("_d") < -tol).alias("losses"),
                 F.percentile("_d", 0.5).alias("median_difference"))


def training_cost(trace: DataFrame, lengths: list[int]) -> DataFrame:
    """Fits, mean samples, total and median seconds, fits per window length, by arm."""
    return trace.groupBy("arm").agg(
        F.count("*").alias("fits"), F.avg("samples").alias("mean_samples"), F.sum("seconds").alias("total_seconds"),
        F.percentile("seconds", 0.5).alias("median_seconds"), *[F.count_if(F.col("days") == d).alias(f"fits_{d}d") for d in lengths])


def stability(window_metrics: DataFrame, by: list[str], value: str, chosen: str, options: list[int]) -> DataFrame:
    return window_metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        *[F.count_if(F.col(chosen) == o).alias(f"chosen_{o}") for o in options])
