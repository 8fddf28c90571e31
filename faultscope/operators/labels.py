"""Forward labels, eligibility and decision gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import DAY, HOUR, idiv
from .joins import Source, asof, asof_multi, not_in_intervals, sweep


def next_event(decisions: DataFrame, onsets: DataFrame, t: str = "t", name: str = "next_onset", bounds=None) -> DataFrame:
    """Next onset strictly after ``t``. ``bounds`` (here and below): first and last decision time, if known."""
    return asof(decisions, onsets, ["entity"], t, "t", {name: "t"}, inclusive=False, forward=True, until=bounds and bounds[0])


def label_future(decisions: DataFrame, onsets: DataFrame, horizon: int = DAY, name: str = "label", bounds=None) -> DataFrame:
    """1 when an onset lies in ``(t, t + horizon]``."""
    d = next_event(decisions, onsets, name="_next", bounds=bounds)
    return d.withColumn(name, F.when(F.col("_next") <= F.col("t") + horizon, 1).otherwise(0).cast("bigint")).drop("_next")


def label_bins(grid: DataFrame, onset_bins: DataFrame, h: int, name: str = "label") -> DataFrame:
    """Inclusive bin rule: positive for ``onset_bin - h .. onset_bin``."""
    d = asof(grid, onset_bins.select("entity", F.col("bin").alias("_ob")), ["entity"], "bin", "_ob", {"_next": "_ob"},
             width=4096, inclusive=True, forward=True)
    return d.withColumn(name, F.when(F.col("_next") <= F.col("bin") + h, 1).otherwise(0).cast("bigint")).drop("_next")


def label_state(decisions: DataFrame, ledger: DataFrame, horizon: int = DAY, bounds=None) -> DataFrame:
    """Label from certain onsets; not eligible inside an episode or with an uncertain onset ahead.

    An onset is ahead of the times from ``onset - horizon`` (with) to ``onset`` (without), so it adds
    one at the first and takes one away at the second; the latest episode begun is a running maximum.
    One sweep over decisions and ledger gives all three.
    """
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    sure, unsure, begun = one(~F.col("uncertain_onset")), one(F.col("uncertain_onset")), F.struct("onset_t", "end_t")

    def mark(at: Column, sign: int, last: Column) -> Column:
        return F.struct(at.alias("_t"), F.lit(0).alias("_kind"), (sure * sign).alias("_c"), (unsure * sign).alias("_u"), last.alias("_last"))

    marks = F.array(mark(F.col("onset_t") - F.lit(horizon), 1, F.when(F.lit(False), begun)), mark(F.col("onset_t"), -1, begun))
    entries = ledger.where("onset_t IS NOT NULL").select("entity", F.explode(marks).alias("_m")).select("entity", "_m.*")
    d = sweep(decisions, entries, ["entity"], F.col("t"), {"_c": "sum", "_u": "sum", "_last": "max"}, DAY, bounds and bounds[1])
    active = F.coalesce(F.col("_last")["end_t"] >= F.col("t"), F.lit(False))
    return d.withColumns({
        "label": F.when(F.col("_c") > 0, 1).otherwise(0).cast("bigint"),
        "eligible": ~active & ~F.coalesce(F.col("_u") > 0, F.lit(False)),
    }).drop("_c", "_u", "_last")


def label_state_for_code(decisions: DataFrame, ledger: DataFrame, code: int, horizon: int = DAY, bounds=None) -> DataFrame:
    return label_state(decisions, ledger.where(F.col("code") == code), horizon, bounds)


def multi_labels(decisions: DataFrame, onsets: DataFrame, codes: list[int], horizon: int = DAY, bounds=None) -> DataFrame:
    """One head per code and an ``any`` head, in one sweep."""
    src = [Source(onsets.where(F.col("code") == c), "t", {f"_n{c}": "t"}, False) for c in codes]
    d = asof_multi(decisions, [Source(onsets, "t", {"_nany": "t"}, False), *src], ["entity"], "t", forward=True, until=bounds and bounds[0])
    heads = {"label_any": "_nany", **{f"label_{c}": f"_n{c}" for c in codes}}
    return d.withColumns({h: F.when(F.col(c) <= F.col("t") + horizon, 1).otherwise(0).cast("bigint") for h, c in heads.items()}).drop(*heads.values())


def label3(positive: Column, unknown: Column) -> Column:
    """Observed positive > unknown > negative."""
    return F.when(positive, "positive").when(unknown, "unknown").otherwise("negative")


def outside_gaps(decisions: DataFrame, gaps: DataFrame, horizon: int) -> DataFrame:
    """Drop decisions whose ``[t, t + horizon]`` overlaps a recording gap (``t < right`` and ``t + h > left``).

    The gap list is not broadcast: each distinct decision time is tested once by a
    sweep over the gaps.
    """
    blocked = gaps.select((F.col("gap_start") - horizon + 1).alias("s"), (F.col("gap_end") - 1).alias("e"))
    times = not_in_intervals(decisions.select("t").distinct(), blocked, [], "t", "s", "e", width=DAY)
    return decisions.join(times, "t", "left_semi")


def valid_decisions(decisions: DataFrame, gaps: DataFrame, horizon: int, first_t, last_t, history: int) -> DataFrame:
    """Enough history, the whole horizon recorded and free of gaps."""
    d = decisions.where((F.col("t") >= first_t + F.lit(history)) & (F.col("t") + F.lit(horizon) <= last_t))
    return outside_gaps(d, gaps, horizon)


def chrono_split(times: DataFrame, fractions=(0.6, 0.8), purge: int = 36 * HOUR, width: int = 30 * DAY) -> DataFrame:
    """Train/validation/test by distinct decision time with a purge around each cut."""
    from .scan import sequence_number

    d = sequence_number(times.select("t").distinct(), [], ["t"], idiv("t", width), "_r")
    n = d.agg(F.max("_r").alias("n"))
    cut = d.agg(*[F.min(F.when(F.col("_r") == F.floor(n.scalar() * f) + 1, F.col("t"))).alias(f"q{i}") for i, f in enumerate(fractions, 1)])
    q1, q2 = cut.select("q1").scalar(), cut.select("q2").scalar()
    t = F.col("t")
    part = (F.when(t <= q1 - purge, "train").when((t >= q1 + purge) & (t <= q2 - purge), "validation")
            .when(t >= q2 + purge, "test").otherwise("purged"))
    return d.select("t", part.alias("part"))


def assign_fold(df: DataFrame, folds: list[tuple[str, int, int]], t: str = "t") -> DataFrame:
    """Named half-open folds, otherwise warm-up."""
    c = F.lit("warmup")
    for name, lo, hi in reversed(folds):
        c = F.when((F.col(t) >= lo) & (F.col(t) < hi), name).otherwise(c)
    return df.withColumn("fold", c)


def origins(grid: DataFrame, bin_col: str, warmup: int, cadence: int) -> DataFrame:
    """Rolling origins: each scores ``[origin, origin + cadence)``."""
    b = grid.agg(F.min(bin_col).alias("lo"), F.max(bin_col).alias("hi"))
    o = b.where(F.col("lo") + warmup <= F.col("hi")).select(
        F.explode(F.sequence(F.col("lo") + warmup, F.col("hi"), F.lit(cadence))).alias("origin"), "hi")
    return o.select("origin", F.least(F.col("origin") + cadence, F.col("hi") + 1).alias("score_end"))


def train_intervals(origin_df: DataFrame, train: int, purge: int, horizon: int) -> DataFrame:
    """``[o - purge - L, o - purge)``; ``mature`` says that all labels are known at the origin."""
    return origin_df.select(
        "origin", (F.col("origin") - purge - train).alias("train_start"), (F.col("origin") - purge).alias("train_end"),
        (F.col("origin") - purge - 1 + horizon < F.col("origin")).alias("mature"))


def expand_schedule(schedule: DataFrame, col: str, step: int, last) -> DataFrame:
    """Every fine bin up to the next scheduled one."""
    nxt = F.coalesce(F.lead(col).over(Window.orderBy(col)), F.lit(last + step) if isinstance(last, int) else last + step)
    d = schedule.select(F.col(col).alias("origin"), (nxt - step).alias("_to"))
    return d.select("origin", F.explode(F.sequence(F.col("origin"), F.col("_to"), F.lit(step))).alias(col))


def positive_intervals(faults: DataFrame, first_t, horizons: dict[str, int], times: dict[str, str]) -> DataFrame:
    """One row per event, horizon and time convention: ``[max(first, t - h), t)``."""
    spec = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(v).alias("len")) for h, v in horizons.items()])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("at")) for k, c in times.items()])
    d = faults.withColumn("_h", F.explode(spec)).withColumn("_k", F.explode(kinds))
    return d.where(F.col("_k.at").isNotNull()).select(
        "entity", "event_id", F.col("_h.horizon").alias("horizon"), F.col("_k.kind").alias("kind"),
        F.greatest(first_t, F.col("_k.at") - F.col("_h.len")).alias("start_t"), F.col("_k.at").alias("end_t"))


def positive_bins(faults: DataFrame, t: str, t0: int, step: int, shifted: Column) -> DataFrame:
    """Per (entity, bin): events, sorted distinct codes joined by ``+``, any shifted time."""
    from ..functions.scalar import bin_index

    return faults.withColumn("bin", bin_index(t, t0, step)).groupBy("entity", "bin").agg(
        F.count("*").alias("events"), F.concat_ws("+", F.sort_array(F.collect_set(F.col("code").cast("string")))).alias("codes"),
        F.bool_or(shifted).alias("any_shifted"))


def step_states(entities: DataFrame, onsets: DataFrame, t0: int, step: int, lo: int, hi: int, past: int, ahead: int) -> DataFrame:
    """Runs of bins ``[bin, end]`` with one ``k`` (onsets in ``[t - past, t)``) and ``label`` (one in ``(t, t + ahead]``) per entity.

    Both change only where an onset enters or leaves its span, so the work follows the onsets and
    the grid is never shuffled: ``run_cells`` lists its rows inside a task. An entity has at most a
    mark per bin.
    """
    after = lambda us: idiv(F.col("t") + F.lit(us - t0), step) + 1  # noqa: E731  first bin later than t + us
    since = lambda us: idiv(F.col("t") + F.lit(us - t0 + step - 1), step)  # noqa: E731  first bin at or after t + us
    marks = [(after(0), 1, 0), (after(past), -1, 0), (since(-ahead), 0, 1), (since(0), 0, -1)]
    m = onsets.select("entity", F.explode(F.array(*[F.struct(F.greatest(b, F.lit(lo)).alias("bin"), F.lit(k).alias("_k"), F.lit(n).alias("_n")) for b, k, n in marks])).alias("_m"))
    m = m.select("entity", "_m.*").where(F.col("bin") <= hi)
    first = entities.select("entity").distinct().select("entity", F.lit(lo).cast("bigint").alias("bin"), F.lit(0).alias("_k"), F.lit(0).alias("_n"))
    m = m.unionByName(first).groupBy("entity", "bin").agg(F.sum("_k").alias("_k"), F.sum("_n").alias("_n"))
    w = Window.partitionBy("entity").orderBy("bin")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return m.select("entity", "bin", (F.coalesce(F.lead("bin").over(w), F.lit(hi + 1)) - 1).alias("end"), F.sum("_k").over(upto).alias("k"), (F.sum("_n").over(upto) > 0).cast("bigint").alias("label"))


def run_cells(runs: DataFrame, parts: int) -> DataFrame:
    """A row per entity and bin of ``step_states``; the runs are dealt to ``parts`` tasks, the rows stay where they are made."""
    return runs.repartition(parts, "entity").withColumn("bin", F.explode(F.sequence("bin", "end"))).drop("end")


def run_cells_by_time(runs: DataFrame, width: int, parts: int, name: str = "_part") -> DataFrame:
    """``run_cells`` with all rows of ``width`` neighbouring bins in one task, so that windows over (``name``, bin) add no exchange.

    Runs are cut at the borders of these spans and dealt out before their rows are listed: what moves is
    a piece per entity and span, not the grid.
    """
    d = runs.withColumn(name, F.explode(F.sequence(F.floor(F.col("bin") / width), F.floor(F.col("end") / width))))
    d = d.withColumns({"bin": F.greatest(F.col("bin"), F.col(name) * width), "end": F.least(F.col("end"), F.col(name) * width + (width - 1))})
    return d.repartition(parts, name).withColumn("bin", F.explode(F.sequence("bin", "end"))).drop("end")
