"""Ranking and probability metrics as grouped aggregates over long score rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import DAY, clip, dcg_discount, ideal_dcg, idiv, score_chunk
from ..session import materialize
from .joins import Source, asof_multi, interval_join
from .ranking import risk_rank, topk
from .scan import scan
from .summaries import with_percentiles


def score_histogram(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Distinct scores with positives and rows; ties collapse before anything is sorted."""
    return df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(F.col(label)).cast("bigint").alias("pos"), F.count("*").alias("n"))


def score_curve(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Histogram plus running positives and rows from the highest score down.

    Two-level scan over score chunks: a pooled metric over all rows never becomes
    a single sorted partition.
    """
    h = score_histogram(df, group, score, label).withColumn("_o", -F.col("score"))
    return scan(h, group, ["_o"], score_chunk("_o"), run={"tp": ("sum", F.col("pos")), "seen": ("sum", F.col("n"))}).drop("_o")


def ranking_quality(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Step-form average precision and tie-aware ROC-AUC.

    AP is 0 without positives; AUC is NULL with one class.
    """
    c = score_curve(df, group, score, label)
    neg = F.col("n") - F.col("pos")
    agg = c.groupBy(*group).agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positives"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / F.col("seen"))).alias("_ap"),
        F.sum(neg * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("_u"))
    p, nn = F.col("positives"), F.col("rows") - F.col("positives")
    return agg.select(
        *group, "rows", "positives",
        F.when(p > 0, F.col("_ap") / p).otherwise(F.lit(0.0)).alias("ap"),
        F.when((p > 0) & (nn > 0), F.col("_u") / (p.cast("double") * nn)).alias("auc"))


def prob_losses(df: DataFrame, group: list[str], p: str, label: str, eps: float = 1e-6) -> DataFrame:
    q, y = clip(p, eps, 1 - eps), F.col(label)
    return df.groupBy(*group).agg(
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        F.avg(p).alias("mean_prediction"), F.avg(y).alias("prevalence"))


def calibration_error(df: DataFrame, group: list[str], p: str, label: str, bins: int = 10) -> DataFrame:
    b = df.withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    g = b.groupBy(*group, "_b").agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(label).alias("my"))
    return g.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def per_time_at_k(df: DataFrame, score: str, ks: list[int], by: list[str], label: str = "label", tie: str = "entity") -> DataFrame:
    """Rows, positives, hits and DCG per time for several K.

    Totals are a plain aggregate; hits need only the ``max(ks)`` best rows per
    time, which Spark prunes map-side. No time is ever ranked in full.
    """
    y = F.col(label)
    total = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    head = topk(df.select(*dict.fromkeys([*by, tie, score, label])), score, max(ks), by, tie)
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, y).otherwise(0)).alias(f"hits_{k}"),
                 F.sum(F.when(inside & (y == 1), dcg_discount("rank")).otherwise(0.0)).alias(f"dcg_{k}")]
    return total.join(head.groupBy(*by).agg(*aggs), by)


def at_k(df: DataFrame, score: str, ks: list[int], by: list[str], group: list[str], label: str = "label", tie: str = "entity") -> DataFrame:
    """Pooled recall/precision/lift and macro recall/NDCG at each K, long by ``k``."""
    per = per_time_at_k(df, score, ks, sorted({*by, *group}), label, tie)
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"), F.col(f"dcg_{k}").alias("dcg"),
                             ideal_dcg("pos", k).alias("ideal")) for k in ks])
    d = per.select(*group, "n", "pos", F.explode(arr).alias("x")).select(*group, "n", "pos", "x.*")
    has = F.col("pos") > 0
    return d.groupBy(*group, "k").agg(
        F.sum("hits").alias("hits"), F.sum("pos").alias("positives"), F.count("*").alias("times"),
        (F.sum("hits") / F.greatest(F.sum("pos"), F.lit(1))).alias("recall"),
        (F.sum("hits") / (F.count("*") * F.col("k"))).alias("precision"),
        (F.sum("hits") / (F.count("*") * F.col("k")) / (F.sum("pos") / F.sum("n"))).alias("lift"),
        F.avg(F.when(has, F.col("hits") / F.col("pos"))).alias("macro_recall"),
        F.avg(F.when(has, F.col("dcg") / F.col("ideal"))).alias("ndcg"))


def fraction_metrics(df: DataFrame, score: str, fractions: list[float], by: list[str], label: str = "label", tie: str = "entity") -> DataFrame:
    """Pooled capture and active-time macro precision/recall in the top fraction per time."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    d = risk_rank(df.select(*by, tie, score, label), score, by, tie).join(n, by)
    size = {i: F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(f)))) for i, f in enumerate(fractions)}
    per = d.groupBy(*by, "_n").agg(F.sum(label).alias("pos"), *[F.sum(F.when(F.col("rank") <= k, F.col(label)).otherwise(0)).alias(f"_h{i}") for i, k in size.items()])
    arr = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), size[i].alias("k"), F.col(f"_h{i}").alias("hits")) for i, f in enumerate(fractions)])
    per = per.select("pos", F.explode(arr).alias("x")).select("pos", "x.*")
    act = F.col("pos") > 0
    return per.groupBy("fraction").agg(
        F.sum("hits").alias("hits"), (F.sum("hits") / F.sum("pos")).alias("capture"),
        (F.sum("hits") / F.sum("k")).alias("precision"), F.avg(F.when(act, F.col("hits") / F.col("pos"))).alias("macro_recall"),
        F.avg(F.when(act, F.col("hits") / F.col("k"))).alias("macro_precision"))


def best_f1(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    c = score_curve(df, group, score, label)
    tot = c.groupBy(*group).agg(F.sum("pos").alias("P"))
    d = c.join(tot, group) if group else c.withColumn("P", tot.scalar())
    d = d.withColumn("f1", 2 * F.col("tp") / (F.col("seen") + F.col("P")))
    key = F.struct("f1", "score")
    return d.groupBy(*group).agg(F.max_by("score", key).alias("threshold"), F.max("f1").alias("f1"))


def at_threshold(df: DataFrame, group: list[str], score: str, label: str, threshold: Column) -> DataFrame:
    hit = F.col(score) >= threshold
    y = F.col(label) == 1
    a = df.groupBy(*group).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit).alias("alerts"), F.count_if(y).alias("pos"))
    return a.select(*group, "tp", "alerts", "pos",
                    F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")).otherwise(F.lit(0.0)).alias("precision"),
                    F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(F.lit(0.0)).alias("recall"),
                    (2 * F.col("tp") / F.greatest(F.col("alerts") + F.col("pos"), F.lit(1))).alias("f1"))


def schedule_index(times: DataFrame) -> tuple[DataFrame, int | None, int | None]:
    """The distinct times, one row a day with the number of times before it; and the first and the last time.

    Written once: it has as many rows as the recording has days, whatever the number of entities.
    """
    per = materialize(times.groupBy(idiv("t", DAY).alias("_d")).agg(F.array_sort(F.collect_set("t")).alias("_ts")), "schedule")
    a, b = per.agg(F.min(F.element_at("_ts", 1)), F.max(F.element_at("_ts", -1))).first()
    every = per.sparkSession.range(a // DAY, b // DAY + 1) if a is not None else per.sparkSession.range(0)
    run = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = every.withColumnRenamed("id", "_d").join(per, "_d", "left").withColumn("_n", F.coalesce(F.sum(F.coalesce(F.size("_ts"), F.lit(0))).over(run), F.lit(0)))
    return materialize(days, "schedule-days"), a, b


def upto(df: DataFrame, days: DataFrame, at: Column, name: str) -> DataFrame:
    """Add the number of scheduled times at or before ``at`` (NULL on a day outside the schedule)."""
    d = df.withColumn("_x", at).withColumn("_d", idiv("_x", DAY)).join(days, "_d", "left")
    return d.withColumn(name, F.col("_n") + F.coalesce(F.size(F.filter("_ts", lambda t: t <= F.col("_x"))), F.lit(0))).drop("_x", "_d", "_ts", "_n")


def onset_capture(top: DataFrame, times: DataFrame, onsets: DataFrame, lo: int, hi: int, step: int, closed: str = "both") -> DataFrame:
    """Per onset: selected at least once in ``[onset - lo, onset - hi]``, first alert and lead.

    ``times`` holds the scheduled times that may be used. An onset is eligible if its window
    begins at or after the first of them, ends at or before the last, and no time of the
    regular schedule (``step``) inside the window is missing; the counts up to both ends are
    looked up in ``schedule_index``.
    """
    on = onsets.select("entity", F.col("t").alias("onset_t")).distinct().withColumns({
        "w_lo": F.col("onset_t") - F.lit(lo), "w_hi": F.col("onset_t") - F.lit(hi)})
    days, a, b = schedule_index(times)
    have = F.coalesce("_upto", F.lit(0)) - F.coalesce("_before", F.lit(0))
    on = upto(upto(on, days, F.col("w_hi"), "_upto"), days, F.col("w_lo") - 1, "_before")
    due = idiv(F.col("w_hi") - F.lit(a), step) - idiv(F.col("w_lo") - F.lit(a) - 1, step)
    full = (F.col("w_lo") >= F.lit(a)) & (F.col("w_hi") <= F.lit(b)) & (due > 0) & (have == due)
    hits = interval_join(top.select("entity", "t"), on, ["entity"], "t", "w_lo", "w_hi", width=lo, closed=closed)
    first = hits.groupBy("entity", "onset_t").agg(F.min("t").alias("first_alert"), F.count("*").alias("alerts"))
    d = on.join(first, ["entity", "onset_t"], "left")
    return d.select("entity", "onset_t", full.alias("eligible"), F.col("first_alert").isNotNull().alias("captured"),
                    F.coalesce("alerts", F.lit(0)).alias("alerts"),
                    ((F.col("onset_t") - F.col("first_alert")) / 3_600_000_000).alias("lead_hours"))


def capture_summary(cap: DataFrame) -> DataFrame:
    e = cap.where("eligible")
    a = e.agg(F.count("*").alias("onsets"), F.count_if("captured").alias("captured"), F.avg(F.col("captured").cast("double")).alias("rate"))
    return with_percentiles(a, e, [], "lead_hours", {"lead_p10": 0.1, "lead_median": 0.5, "lead_p90": 0.9})


def episode_capture(rows: DataFrame, onsets: DataFrame, k: int, horizon: int) -> DataFrame:
    """Capture per code with the expected random rate ``1 - prod(1 - k/n)``.

    ``rows`` holds ranked decisions ``entity, t, rank, n``; each is matched to the
    next onset within the horizon.
    """
    d = asof_multi(rows, [Source(onsets, "t", {"onset_t": "t", "code": "code"}, False)], ["entity"], "t", forward=True)
    d = d.where(F.col("onset_t") <= F.col("t") + horizon)
    miss = F.when(F.col("n") > k, F.log(1 - F.lit(float(k)) / F.col("n"))).otherwise(F.lit(-1e9))
    hit = F.col("rank") <= k
    ep = d.groupBy("entity", "code", "onset_t").agg(
        F.max(hit.cast("int")).alias("hit"), (1 - F.exp(F.sum(miss))).alias("random"),
        F.min(F.when(hit, F.col("t"))).alias("first_t"))
    a = ep.groupBy("code").agg(F.count("*").alias("episodes"), F.sum("hit").alias("captured"), F.avg("hit").alias("rate"), F.avg("random").alias("random_rate"))
    lead = ep.select("code", ((F.col("onset_t") - F.col("first_t")) / 3_600_000_000).alias("_lead"))
    return with_percentiles(a, lead, ["code"], "_lead", {"median_lead_hours": 0.5})


def random_reference(n: Column, k: int, times_per_day: int = 287, steps_per_hour: int = 12) -> list[Column]:
    f = F.lit(float(k)) / n
    return [f.alias("recall"), (1 - F.pow(1 - f, F.lit(times_per_day))).alias("capture"), (k * (1 - f) * steps_per_hour).alias("churn_per_hour")]


def mean_time_ap(df: DataFrame, by: list[str], group: list[str], score: str, label: str) -> DataFrame:
    """AP per decision time (0 without positives), averaged; prevalence likewise."""
    q = ranking_quality(df, sorted({*by, *group}), score, label)
    return q.groupBy(*group).agg(F.avg("ap").alias("mean_ap"), F.avg(F.col("positives") / F.col("rows")).alias("mean_prevalence"))


def population_table(df: DataFrame, block: str, group: list[str], label: str = "label") -> DataFrame:
    b = df.groupBy(*group, block).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    return b.groupBy(*group).agg(
        F.sum("n").alias("rows"), F.sum("p").alias("positives"), (F.sum("p") / F.sum("n")).alias("prevalence"),
        F.count("*").alias("blocks"), F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("two_class_blocks"))


def split_rows(df: DataFrame, terminal_start: int, bin_col: str = "bin") -> DataFrame:
    """Each row counts for ``full`` and for its side of the terminal cut."""
    side = F.when(F.col(bin_col) < terminal_start, "development").otherwise("terminal")
    return df.withColumn("split", F.explode(F.array(side, F.lit("full"))))


def unpivot_models(df: DataFrame, ids: list[str], models: list[str]) -> DataFrame:
    return df.unpivot(ids, models, "model", "score")


def compare_summary(metrics: DataFrame, base: str, keys: list[str], value: str, tol: float = 1e-12) -> DataFrame:
    """Per model against the base: mean, wins, losses, worst block."""
    b = metrics.where(F.col("model") == base).select(*keys, F.col(value).alias("_b"))
    d = metrics.where(F.col("model") != base).join(b, keys).withColumn("_d", F.col(value) - F.col("_b"))
    q = F.percentile("_d", 0.5)
    return d.groupBy("model").agg(
        F.avg(value).alias("mean"), F.avg("_d").alias("mean_delta"), q.alias("median_delta"),
        F.count_if(F.col("_d") > tol).alias("wins"), F.count_if(F.abs("_d") <= tol).alias("ties"), F.count_if(F.col("_d") < -tol).alias("losses"),
        F.min("_d").alias("worst_delta"))
