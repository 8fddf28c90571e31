"""Training-length and observation-window search at every rolling origin.

An interval table (origin x length, purged on both sides of the validation span) is joined to the
rows; nothing loops over lengths. Each origin has one sample, drawn for its longest span: a row
carries its ``reach`` back from the span's end, and a length takes the rows within its reach, so
7 days lie in 14 and 14 in 21. The sample is written once and serves all fits.

``RateSelector`` scores by smoothed rates of positives in buckets of a whole-number feature: its
fit is one aggregate for all origins, lengths and windows together, and its scores land in one
long table. ``fit_scores`` fits pipelines for the same settings, one Spark job each, and writes
the time and sample of every fit to a trace table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import metrics as M
from ..operators.ranking import best_row
from ..operators.sampling import sample_negatives
from ..session import exists, materialize
from . import models as Mo


@dataclass(frozen=True)
class Search:
    """Lengths and spans in days; ``day`` is the number of bins of a day."""

    day: int
    lengths: tuple[int, ...] = (7, 14, 21)
    validation: int = 3
    purge_hours: int = 36
    ratio: float = 4.0
    cap: int = 250_000
    seed: int = 42

    @property
    def purge(self) -> int:
        return -(-self.purge_hours * self.day // 24)

    def ends(self, origin: int) -> tuple[int, int, int]:
        """(end of training, start and end of validation), the gaps being the purge."""
        hi = origin - self.purge
        lo = hi - self.validation * self.day
        return lo - self.purge, lo, hi


@dataclass(frozen=True)
class RateSelector:
    """Rates of positives by bucket: ``least(most, feature)`` of the column of an observation window."""

    name: str
    most: int

    def bucket(self, tag) -> Column:
        return F.least(F.lit(self.most), F.greatest(F.lit(0), F.coalesce(F.col(f"{self.name}_{tag}"), F.lit(0)))).cast("bigint")


def interval_table(spark: SparkSession, origins: list[int], s: Search) -> DataFrame:
    """origin, t_lo, t_hi (longest training span), v_lo, v_hi; grows with the schedule."""
    rows = [(o, t - max(s.lengths) * s.day, t, lo, hi) for o in origins for t, lo, hi in (s.ends(o),)]
    return spark.createDataFrame(rows, "origin bigint, t_lo bigint, t_hi bigint, v_lo bigint, v_hi bigint")


def within(df: DataFrame, intervals: DataFrame, lo: str, hi: str, day: int) -> DataFrame:
    """Rows in ``[lo, hi)`` of each interval, by an equi-join on days."""
    span = intervals.withColumn("_day", F.explode(F.sequence(F.floor(F.col(lo) / day), F.floor((F.col(hi) - 1) / day))))
    return df.withColumn("_day", F.floor(F.col("bin") / day)).join(span, "_day").where((F.col("bin") >= F.col(lo)) & (F.col("bin") < F.col(hi))).drop("_day")


def nested_sample(df: DataFrame, intervals: DataFrame, s: Search) -> DataFrame:
    """Positives and sampled negatives of the longest span of every origin, with ``reach``."""
    d = within(df.where("eligible"), intervals.select("origin", "t_lo", "t_hi"), "t_lo", "t_hi", s.day)
    d = d.withColumn("reach", F.col("t_hi") - F.col("bin")).drop("t_lo", "t_hi")
    return sample_negatives(d, ["origin"], "label", s.ratio, s.cap, ["entity", "bin"], s.seed)


def validation_rows(df: DataFrame, intervals: DataFrame, s: Search) -> DataFrame:
    return within(df.where("eligible"), intervals.select("origin", "v_lo", "v_hi"), "v_lo", "v_hi", s.day).drop("v_lo", "v_hi")


def rate_scores(sample: DataFrame, validation: DataFrame, s: Search, selectors: list[RateSelector], tags: list[int]) -> DataFrame:
    """One long table (origin, days, hours, entity, bin, label, score) of all settings; the score is the mean of the selectors."""
    def places(tag):
        return [F.lit(100_000 * k) + x.bucket(tag) for k, x in enumerate(selectors)]

    spread = F.explode(F.array(*[F.struct(F.lit(t).alias("hours"), F.array(*places(t)).alias("at")) for t in tags]))
    # The shortest length that holds the row; longer ones hold it as well.
    band = reduce(lambda out, d: F.when(F.col("reach") <= d * s.day, F.lit(d)).otherwise(out), sorted(s.lengths, reverse=True), F.lit(None).cast("int"))
    n = sample.select("origin", "label", band.alias("band"), spread.alias("x")).select("origin", "band", "label", F.col("x.hours").alias("hours"), F.explode("x.at").alias("at"))
    n = n.groupBy("origin", "hours", "at", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    longer = F.filter(F.array(*[F.lit(d) for d in s.lengths]), lambda d: d >= F.col("band"))
    n = n.withColumn("days", F.explode(longer)).groupBy("origin", "days", "hours", "at").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    rate = (F.col("p") + 1) / (F.col("n") + 2)
    tables = n.groupBy("origin", "days", "hours").agg(F.map_from_entries(F.collect_list(F.struct("at", rate.alias("r")))).alias("rates"))  # selectors x buckets entries
    tables = materialize(tables, "rates")  # a row a setting; its known size spares the validation rows a shuffle
    v = validation.select("origin", "entity", "bin", "label", spread.alias("x")).select("origin", "entity", "bin", "label", F.col("x.hours").alias("hours"), F.col("x.at").alias("at"))
    mean = F.aggregate(F.transform("at", lambda a: F.coalesce(F.try_element_at("rates", a), F.lit(0.5))), F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(selectors)))
    return v.join(tables, ["origin", "hours"]).select("origin", "days", "hours", "entity", "bin", "label", mean.alias("score"))


def setting_quality(scores: DataFrame) -> DataFrame:
    """AP of every (origin, days, hours) and which one its origin takes: best AP, then longer, then the shorter look back."""
    q = M.ranking_quality(scores, ["origin", "days", "hours"], "score", "label").drop("auc").withColumn("ap", F.round("ap", 9))
    best = best_row(q, ["origin"], [F.col("ap").desc(), F.col("days").desc(), F.col("hours")])
    return q.join(best.select("origin", F.col("days").alias("_d"), F.col("hours").alias("_h")), "origin").withColumn("chosen", (F.col("days") == F.col("_d")) & (F.col("hours") == F.col("_h"))).drop("_d", "_h")


def fit_scores(sample: DataFrame, validation: DataFrame, s: Search, origins: list[int], selectors: dict[int, list[Pipeline]], arm: str, trace: str, threads: int = 3) -> DataFrame:
    """``rate_scores`` for pipelines: ``selectors`` by observation window. Every fit appends a row to the ``trace`` table."""
    def one(job):
        o, days, hours = job
        rows = sample.where((F.col("origin") == o) & (F.col("reach") <= days * s.day))
        v, cols = validation.where(F.col("origin") == o), []
        for i, p in enumerate(selectors[hours]):
            v = Mo.score(traced(lambda p=p: Mo.fit(p, rows), rows, trace, arm, o, days, f"{hours}-{i}"), v, f"_s{i}")
            cols.append(F.col(f"_s{i}"))
        mean = reduce(lambda a, b: a + b, cols) / len(cols)
        return v.select("origin", F.lit(days).alias("days"), F.lit(hours).alias("hours"), "entity", "bin", "label", mean.alias("score"))

    jobs = [(o, d, h) for o in origins for d in s.lengths for h in selectors]
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, jobs))
    return reduce(DataFrame.unionByName, parts)


def traced(fit: Callable, rows: DataFrame, path: str, arm: str, origin: int, days: int, part: str):
    """Run a fit and add its sample, wall time and setting to the trace table: a folder a fit, as fits run side by side."""
    start = time.perf_counter()
    model = fit()
    seconds = time.perf_counter() - start
    row = rows.agg(F.count(F.lit(1)).alias("samples"), F.sum("label").alias("positives"))
    row.select(F.lit(arm).alias("arm"), F.lit(origin).cast("bigint").alias("origin"), F.lit(days).cast("bigint").alias("days"), F.lit(part).alias("part"),
               "samples", "positives", F.lit(seconds).alias("seconds")).write.mode("overwrite").parquet(f"{path}/{arm}-{origin}-{days}-{part}")
    return model


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/*")


def hold_or_search(path: str, cycles: DataFrame, scores: DataFrame, origins: list[int], step: Callable[[DataFrame], DataFrame], zero: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The controller over origins as a versioned one-row table: (states, scores of the chosen settings).

    ``step`` maps one row (state ``s``, ``scores`` of the origin's settings) to the next state. An
    origin's scores are written first and its state last, so an origin without a finished state is
    done again, and a run that was stopped goes on from the last state on disk.
    """
    spark = cycles.sparkSession
    state = zero
    for o in origins:
        at, out = f"{path}/state/origin={o}", f"{path}/scores/origin={o}"
        if not exists(spark, f"{at}/_SUCCESS"):
            nxt = step(cycles.where(F.col("origin") == o).select(F.lit(0).alias("_k"), "scores").join(state.withColumn("_k", F.lit(0)), "_k"))  # one row each
            chosen = nxt.select("s.days", "s.hours").first()
            scores.where((F.col("origin") == o) & (F.col("days") == chosen["days"]) & (F.col("hours") == chosen["hours"])).drop("origin").write.mode("overwrite").parquet(out)
            nxt.select("s").write.mode("overwrite").parquet(at)
        state = spark.read.schema(zero.schema).parquet(at)
    read = lambda kind: spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/origin={o}" for o in origins]).withColumn("origin", F.col("origin").cast("bigint"))
    return read("state").select("origin", "s.*"), read("scores")
