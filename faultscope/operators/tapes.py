"""Fault tapes, censoring evidence and observability summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import DAY, MINUTE, event_label, idiv, valid_code
from .episodes import longest_run
from .joins import interval_join
from .scan import scan


def fault_tape(events: DataFrame, runs: DataFrame, unit: int, min_run: float = 3.0) -> DataFrame:
    """Raw, onset and mixed fault time with evidence labels.

    ``events``: ``event_id, entity, grp, code, start_t, episode_id, cluster_size, class``;
    ``runs``: ``event_id, run`` (terminal-low length in units).
    """
    d = events.join(runs, "event_id", "left")
    low = F.coalesce(F.col("run") >= min_run, F.lit(False))
    onset = F.when(low, F.col("start_t") - (F.col("run") * unit).cast("bigint"))
    kind = F.coalesce("class", F.lit("unclassified"))
    interrupt = (F.when(kind.contains("power_loss"), "shutdown_like").when(kind == "no_signature", "no_terminal_inactivity")
                 .when(kind.contains("unobserved"), "observability_limited").otherwise("unclassified"))
    return d.select(
        "event_id", event_label("code", "entity", "episode_id").alias("fault_id"), "entity", "grp", "code",
        F.col("start_t").alias("time_raw"), onset.alias("time_onset"), F.coalesce(onset, F.col("start_t")).alias("time_mixed"),
        F.when(low, "terminal_low_supported").when(F.col("run").isNotNull(), "audited_no_terminal_low").otherwise("not_audited").alias("evidence"),
        F.when(F.col("cluster_size") > 1, "multi_entity_same_group_time").otherwise("single_entity").alias("scope"),
        interrupt.alias("interrupt"))


def event_neighbourhood(log: DataFrame, events: DataFrame, window: int, max_gap: int, width: int = DAY) -> DataFrame:
    """Censoring evidence around an event from the log.

    Previous and next row missing or too far, last observed time and zero inside
    the window before the event, valid fraction, and longest missing run (rows).
    ``events``: ``event_id, entity, start_t``.
    """
    rows = log.select("entity", "t", valid_code("code").alias("c"))
    rows = scan(rows, ["entity"], ["t"], idiv("t", width), lag={"_pc": "c", "_pt": "t"}, lead={"_nc": "c", "_nt": "t"})
    at = rows.select("entity", F.col("t").alias("start_t"),
                     (F.col("_pt").isNull() | F.col("_pc").isNull() | (F.col("t") - F.col("_pt") > max_gap)).alias("left_censored"),
                     (F.col("_nt").isNull() | F.col("_nc").isNull() | (F.col("_nt") - F.col("t") > max_gap)).alias("right_censored"))
    d = events.select("event_id", "entity", "start_t").join(at, ["entity", "start_t"], "left")
    iv = events.select("event_id", "entity", (F.col("start_t") - window).alias("_lo"), F.col("start_t").alias("_hi"))
    near = interval_join(log.select("entity", "t", valid_code("code").alias("c")), iv, ["entity"], "t", "_lo", "_hi", width=window)
    w = Window.partitionBy("event_id").orderBy("t")
    near = near.withColumn("_isl", F.row_number().over(w) - F.count("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Rows of one missing run share the number of valid rows before them.
    near = near.withColumn("_run", F.row_number().over(w) - F.col("_isl"))
    runs = near.where(F.col("c").isNull()).groupBy("event_id", "_run").agg(F.count("*").alias("n")).groupBy("event_id").agg(F.max("n").alias("missing_run"))
    agg = near.groupBy("event_id").agg(
        F.max(F.when(F.col("c").isNotNull(), F.col("t"))).alias("last_observed_t"), F.max(F.when(F.col("c") == 0, F.col("t"))).alias("last_zero_t"),
        (F.count("c") / F.count("*")).alias("valid_fraction"), F.count("*").alias("rows"))
    return d.join(agg, "event_id", "left").join(runs, "event_id", "left").select(
        "event_id", "entity", "start_t", "left_censored", "right_censored", "last_observed_t", "last_zero_t",
        F.coalesce("valid_fraction", F.lit(0.0)).alias("valid_fraction"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("missing_run", F.lit(0)).alias("missing_run"))


def fault_tape_v2(events: DataFrame, evidence: DataFrame, step: int, high=(0.99, 4), moderate: float = 0.95) -> DataFrame:
    """Early bound, onset uncertainty and observability status; a missing flag counts as censored."""
    d = events.select("event_id", F.col("start_t").alias("time_raw")).join(evidence.drop("start_t"), "event_id", "left")
    use = F.coalesce("left_censored", F.lit(True)) & F.col("last_zero_t").isNotNull()
    early = F.when(use, F.col("last_zero_t") + step).otherwise(F.col("time_raw"))
    return d.withColumns({
        "time_early": early,
        "uncertainty_s": F.greatest(F.lit(0.0), (F.col("time_raw") - early) / 1_000_000),
        "status": F.when((F.col("valid_fraction") >= high[0]) & (F.col("missing_run") <= high[1]), "high")
        .when(F.col("valid_fraction") >= moderate, "moderate").otherwise("low"),
        "duration_status": F.when(F.coalesce("right_censored", F.lit(True)), "right_censored").otherwise("observed_transition"),
    })


def observability_summary(grid: DataFrame, keys: list[str], valid: str, expected: str, bin_minutes: float) -> DataFrame:
    """Missing rate, share of incomplete bins, longest incomplete and empty runs, median coverage."""
    v, e = F.col(valid), F.col(expected)
    base = grid.groupBy(*keys).agg(
        (1 - F.sum(valid) / F.sum(expected)).alias("missing_rate"), F.avg((v < e).cast("double")).alias("incomplete_share"),
        F.percentile(v / e, 0.5).alias("median_coverage"))
    part = longest_run(grid, keys, "bin", v < e).withColumnRenamed("max_run", "_any")
    none = longest_run(grid, keys, "bin", v == 0).withColumnRenamed("max_run", "_zero")
    d = base.join(part, keys, "left").join(none, keys, "left")
    return d.select(*keys, "missing_rate", "incomplete_share", "median_coverage",
                    (F.coalesce("_any", F.lit(0)) * bin_minutes).alias("longest_incomplete_min"),
                    (F.coalesce("_zero", F.lit(0)) * bin_minutes).alias("longest_empty_min"))


def label_readiness(intervals: DataFrame, tape: DataFrame, by: list[str]) -> DataFrame:
    """Per horizon and code: intervals and shares of censored, early-bounded and well observed events."""
    d = intervals.join(tape.select("event_id", "left_censored", "last_zero_t", "status"), "event_id")
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy(*by).agg(
        F.count("*").alias("intervals"), share(F.coalesce("left_censored", F.lit(True))).alias("left_censored_share"),
        share(F.col("last_zero_t").isNotNull()).alias("early_bound_share"), share(F.col("status") == "high").alias("high_share"))


def risk_tape(ranked: DataFrame, observability: DataFrame, cutoff: int = 10 * MINUTE) -> DataFrame:
    """Contract columns of a risk tape."""
    return ranked.join(observability, ["entity", "bin"], "left").select(
        F.col("t").alias("decision_t"), "entity", F.col("score").alias("risk_score"), F.col("rank").alias("risk_rank"),
        "observability", F.col("fold").alias("model_fold"), (F.col("t") - cutoff).alias("feature_cutoff_t"))
