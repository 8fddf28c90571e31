"""Event-aligned curves, matched controls and differences in change."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import DAY, HOUR, activity_state, idiv
from ..session import materialize
from .joins import asof, not_in_intervals
from .scan import running
from .summaries import with_percentiles


def curves(tel: DataFrame, points: DataFrame, keys: list[str], point_id: str, at: str, metrics: list[str], unit: int, start: int, end: int, width: int = DAY) -> DataFrame:
    """Long curves ``(point, metric, offset, mean, n)`` for offsets ``[start, end)`` in units.

    Readings and points are never paired: running sums and counts of the readings are looked up
    at the ``end - start + 1`` borders of each point, and neighbouring borders subtracted. The
    work is readings + points x borders, however many of both a key has. Means come from
    differences of sums, so they are as exact as the running sums (whole numbers: exactly).
    """
    runs = {"_c": ("sum", F.lit(1).cast("bigint"))}
    for m in metrics:
        runs |= {f"_s_{m}": ("sum", F.coalesce(F.col(m).cast("double"), F.lit(0.0))), f"_n_{m}": ("sum", F.col(m).isNotNull().cast("bigint"))}
    upto = running(tel.select(*keys, "t", *metrics), keys, ["t"], idiv("t", width), runs).drop(*metrics)
    border = points.select(*keys, point_id, F.col(at).alias("_at"), F.explode(F.sequence(F.lit(start), F.lit(end))).alias("offset"))
    border = border.withColumn("_bt", F.col("_at") + F.col("offset") * F.lit(unit))
    # ``_c`` leads the payload: of equal times the row with all of them is taken.
    d = asof(border, upto, keys, "_bt", "t", {c: c for c in runs}, width, inclusive=False)
    w = Window.partitionBy(point_id).orderBy("offset")
    zero = lambda c: F.coalesce(c, F.lit(0))
    for m in metrics:
        n, x = (zero(F.lead(c).over(w)) - zero(F.col(c)) for c in (f"_n_{m}", f"_s_{m}"))
        d = d.withColumns({f"_dn_{m}": n, f"_dx_{m}": x})
    arr = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(F.col(f"_dx_{m}"), F.col(f"_dn_{m}")).alias("mean"), F.col(f"_dn_{m}").alias("n")) for m in metrics]))
    return (d.where(F.col("offset") < end).select(point_id, F.col("offset").cast("bigint").alias("offset"), arr.alias("x"))
            .select(point_id, "offset", "x.*").where(F.col("n") > 0))


def curve_windows(cv: DataFrame, point_id: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Median of the bin means and number of valid bins per named window."""
    aggs = []
    for n, (a, b) in windows.items():
        inside = (F.col("offset") >= a) & (F.col("offset") < b)
        aggs += [F.percentile(F.when(inside, F.col("mean")), 0.5).alias(n), F.count_if(inside).alias(f"{n}_bins")]
    return cv.groupBy(point_id, "metric").agg(*aggs)


def cluster_effect(df: DataFrame, cluster: list[str], group: list[str], value: str) -> DataFrame:
    """Median inside clusters first, then median, quartiles and share positive over clusters."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, *cluster).agg(F.percentile(value, 0.5).alias("_m"))
    c = materialize(c, "clusters")  # a cluster is small, a group is not: its quantiles come from counts
    a = c.groupBy(*group).agg(F.count("*").alias("clusters"), F.avg((F.col("_m") > 0).cast("double")).alias("share_positive"))
    return with_percentiles(a, c, group, "_m", {"median": 0.5, "q25": 0.25, "q75": 0.75})


def normalised_curves(cv: DataFrame, point_id: str, base: tuple[int, int], min_bins: int) -> DataFrame:
    """Curve minus the point's baseline median; points with a thin baseline drop out."""
    inside = (F.col("offset") >= base[0]) & (F.col("offset") < base[1])
    b = cv.where(inside).groupBy(point_id, "metric").agg(F.percentile("mean", 0.5).alias("_base"), F.count("*").alias("_nb"))
    return cv.join(b.where(F.col("_nb") >= min_bins), [point_id, "metric"]).select(
        point_id, "metric", "offset", (F.col("mean") - F.col("_base")).alias("change"))


def curve_summary(norm: DataFrame, events: DataFrame, point_id: str, cluster: list[str], group: list[str]) -> DataFrame:
    d = norm.join(events.select(point_id, *dict.fromkeys([*cluster, *group])), point_id)
    return cluster_effect(d, cluster, [*group, "metric", "offset"], "change")


def control_candidates(events: DataFrame, t0: Column, t1: Column, period: int = 7 * DAY, shifts: int = 13, margin: int = HOUR,
                       entity_block: tuple[int, int] = (72 * HOUR, 72 * HOUR), group_block: tuple[int, int] = (2 * HOUR, 2 * HOUR)) -> DataFrame:
    """Same entity, event time shifted by whole periods, away from every event of the entity and of its group.

    ``events``: ``event_id, entity, grp, start_t, end_t``.
    """
    ks = F.array(*[F.lit(k) for k in range(-shifts, shifts + 1) if k])
    c = events.select("event_id", "entity", "grp", "start_t", F.explode(ks).alias("shift"))
    c = c.withColumn("point_t", F.col("start_t") + F.col("shift") * F.lit(period)).where(
        (F.col("point_t") >= t0 + F.lit(margin)) & (F.col("point_t") <= t1 - F.lit(margin)))
    for key, (b, a) in (("entity", entity_block), ("grp", group_block)):
        iv = events.select(key, (F.col("start_t") - b).alias("s"), (F.col("end_t") + a).alias("e"))
        c = not_in_intervals(c, iv, [key], "point_t", "s", "e", until=t1)
    return c


def caliper(pairs: DataFrame, event_base: str, control_base: str, limit: float, min_bins: int, event_bins: str, control_bins: str) -> DataFrame:
    """Same activity class, enough baseline bins, baselines within the caliper."""
    diff = F.abs(F.col(event_base) - F.col(control_base))
    return pairs.where((F.col(event_bins) >= min_bins) & (F.col(control_bins) >= min_bins)
                       & (activity_state(event_base) == activity_state(control_base)) & (diff <= limit)).withColumn("abs_diff", diff)


def greedy_match(cands: DataFrame, period: int = 7 * DAY) -> DataFrame:
    """One control per event, each point used once; scarce events choose first.

    Events contend only when they can reach the same point: same entity and same
    phase of the shift period. That phase is the grouping key, so a group holds at
    most one event per period of the recording whatever the size of the entity.
    Groups with a single event need no negotiation and stay in the engine; the rows of the
    others pass in order of group and turn, many groups in one Arrow batch.
    """
    c = materialize(cands.withColumn("_phase", F.pmod(F.col("start_t"), F.lit(period))), "contenders")  # read four times
    per = c.groupBy("event_id").agg(F.count("*").alias("eligible_candidates"))
    c = c.withColumn("_group", F.struct("entity", "_phase"))  # a NULL entity is a group too
    crowd = c.select("_group", "event_id").distinct().groupBy("_group").agg(F.count("*").alias("_crowd"))
    c = c.join(per, "event_id").join(crowd, "_group")
    order = [F.col("abs_diff"), F.abs("shift"), F.col("shift")]
    w = Window.partitionBy("event_id").orderBy(*order)
    cols = ["entity", "event_id", "shift", "point_t", "abs_diff", "eligible_candidates"]
    alone = c.where(F.col("_crowd") == 1).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*cols)

    def negotiate(batches):
        group, taken, done = None, set(), set()
        for b in batches:
            keep = []
            for i, (*at, ev, pt) in enumerate(zip(*(b.column(n).to_pylist() for n in ("entity", "_phase", "event_id", "point_t")))):
                if at != group:
                    group, taken, done = at, set(), set()
                if ev not in done and pt not in taken:
                    taken.add(pt)
                    done.add(ev)
                    keep.append(i)
            yield b.select(cols).take(pa.array(keep, pa.int64()))

    schema = c.select(*cols).schema
    turn = c.where(F.col("_crowd") > 1).repartition("entity", "_phase").sortWithinPartitions("entity", "_phase", "eligible_candidates", "event_id", *order)
    return alone.unionByName(turn.select("_phase", *cols).mapInArrow(negotiate, schema))


def difference_in_change(event_w: DataFrame, control_w: DataFrame, matched: DataFrame, base: str, targets: list[str]) -> DataFrame:
    """(event target - event baseline) - (control target - control baseline), long by comparison."""
    e = event_w.select("event_id", "metric", F.col(base).alias("eb"), *[F.col(t).alias(f"e_{t}") for t in targets])
    k = control_w.select("point_id", "metric", F.col(base).alias("cb"), *[F.col(t).alias(f"c_{t}") for t in targets])
    d = matched.join(e, "event_id").join(k, ["point_id", "metric"])
    arr = F.array(*[F.struct(F.lit(t).alias("comparison"), (F.col(f"e_{t}") - F.col("eb")).alias("event_change"),
                             (F.col(f"c_{t}") - F.col("cb")).alias("control_change")) for t in targets])
    d = d.withColumn("x", F.explode(arr)).select(*matched.columns, "metric", "x.*")
    return d.withColumn("difference", F.col("event_change") - F.col("control_change"))


def trailing_run(cv: DataFrame, point_id: str, threshold: float, length: int = 30) -> DataFrame:
    """Consecutive bins at or below the threshold ending right before the event.

    A missing bin breaks the run; NULL when the last bin is missing. ``cv`` holds
    only valid bins, so the run ends at the larger of the last breaker and the
    last hole, found from counts alone.
    """
    before = cv.where((F.col("offset") >= -length) & (F.col("offset") < 0))
    low = F.col("mean") <= threshold
    w = Window.partitionBy(point_id, "metric").orderBy(F.desc("offset"))
    # Going backwards, the i-th row is part of the run while it sits at offset -i and is low.
    d = before.withColumn("_i", F.row_number().over(w))
    ok = F.when(low & (F.col("offset") == -F.col("_i")), 1).otherwise(0)
    d = d.withColumn("_ok", F.min(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(point_id, "metric").agg(
        F.when(F.max("offset") == -1, F.sum("_ok")).cast("double").alias("run"))


def lag_sensitivity(runs: DataFrame, is_event: str, durations: list[int]) -> DataFrame:
    """Share of events and controls with a run of at least each duration, and their difference."""
    d = runs.withColumn("duration", F.explode(F.array(*[F.lit(x) for x in durations])))
    flag = (F.coalesce("run", F.lit(0.0)) >= F.col("duration")).cast("double")
    a = d.groupBy("duration").agg(F.avg(F.when(F.col(is_event), flag)).alias("event_share"), F.avg(F.when(~F.col(is_event), flag)).alias("control_share"))
    return a.withColumn("risk_difference", F.col("event_share") - F.col("control_share"))


def cluster_synchrony(runs: DataFrame, cluster: list[str], t: str, unit: int) -> DataFrame:
    """Share low, median run, and the spread of inferred onsets when two or more are detected."""
    onset = F.when(F.col("run") > 0, F.col(t) - (F.col("run") * unit).cast("bigint"))
    d = runs.withColumn("_on", onset)
    n = F.count("_on")
    return d.groupBy(*cluster).agg(
        F.count("*").alias("members"), (n / F.count("*")).alias("share_low"), F.percentile(F.when(F.col("run") > 0, F.col("run")), 0.5).alias("median_run"),
        F.when(n >= 2, (F.max("_on") - F.min("_on")) / 60_000_000).alias("spread_minutes"))


def confirm_metrics(windows: DataFrame, runs: DataFrame, base: str, final: str, min_run: float) -> DataFrame:
    """Median change from baseline to the final window among events with a terminal run."""
    hit = runs.where(F.col("run") >= min_run).select("event_id").distinct()
    d = windows.join(hit, "event_id", "left_semi").withColumn("_c", F.col(final) - F.col(base))
    d = materialize(d.select("metric", "_c"), "changes")
    return with_percentiles(d.groupBy("metric").agg(F.count("_c").alias("cases")), d, ["metric"], "_c", {"median_change": 0.5})


def mechanism_rates(df: DataFrame, cluster: list[str], flags: dict[str, Column]) -> DataFrame:
    """Cluster-level shares of each flag, averaged over clusters; rows are events."""
    d = df.withColumns({n: c.cast("double") for n, c in flags.items()})
    per = d.groupBy(*cluster).agg(*[F.percentile(n, 0.5).alias(n) for n in flags])
    return per.agg(F.count("*").alias("clusters"), *[F.avg((F.col(n) >= 0.5).cast("double")).alias(n) for n in flags])


def classify(run: str, ratio: str, low_run: float = 3.0, low_ratio: float = 0.8) -> Column:
    """Five classes; the missing class is tested first."""
    r, p = F.col(run), F.col(ratio)
    return (F.when(r.isNull() & p.isNull(), "unobserved")
            .when((r >= low_run) & (p <= low_ratio), "drop_with_power_loss")
            .when(r >= low_run, "drop_only")
            .when(p <= low_ratio, "power_loss_only")
            .otherwise("no_signature"))
