"""Tail swaps chosen on past days only: all settings of a time at once, selection, day-block bootstrap.

A setting is (m, n, swaps, ratio): challengers come from the base Top-m and the challenger
Top-n, at most ``swaps`` of them replace the tail of the base Top-k, and each must have
``ratio`` times the risk of the row it replaces. The i-th challenger of a pool (m, n) meets
slot k + 1 - i whatever the other two numbers are, and the chain stops at its first failure.
So one chain per pool and ratio serves all limits: a meeting counts for every limit of at
least i. Nothing is swapped to evaluate a setting; hits and DCG of a time are those of the
base list plus sums along the chain.

Rows that take part are at most k + max(m) + max(n) a time; the rest are only counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import mix_hash
from ..operators.ranking import best_row, swap_tail, topk
from ..session import materialize
from . import models as Mo


@dataclass(frozen=True)
class Grid:
    """Settings to compare. ``fallback`` is the pool that is reported when nothing is chosen."""

    k: int = 100
    m: tuple[int, ...] = (150, 250, 400)
    n: tuple[int, ...] = (50, 100, 200)
    swaps: tuple[int, ...] = (5, 10)
    ratios: tuple[float, ...] = (1.0, 1.2)
    fallback: tuple[int, int] = field(default=(150, 50))


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ideal(positives: Column, k: int) -> Column:
    """DCG of a list that has all positives, at most k, in front."""
    sums, total = [], F.lit(0.0)
    for r in range(1, k + 1):
        total = total + discount(F.lit(r).cast("double"))
        sums.append(total)
    return F.element_at(F.array(*sums), F.greatest(F.lit(1), F.least(positives, F.lit(k))).cast("int"))


def heads(df: DataFrame, g: Grid, by=("bin",), entity: str = "entity") -> DataFrame:
    """The rows that any setting of the grid can meet, with ``positives`` of all rows of their time.

    No row behind both Top-r (r the largest of k, m and n) is in a list or a pool, and of a row behind
    one of them only that matters: its rank there reads r + 1. So a time is never ranked in full;
    each map task sends r rows a time and list.
    """
    r, keys = max(g.k, *g.m, *g.n), [*by, entity]
    one, two = (topk(df, p, r, by, entity, n) for p, n in (("p1", "rank1"), ("p2", "rank2")))
    both = one.select(*df.columns, "rank1", F.lit(r + 1).alias("rank2")).unionByName(two.select(*df.columns, F.lit(r + 1).alias("rank1"), "rank2"))
    rest = [c for c in df.columns if c not in keys]
    d = both.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.min("rank1").alias("rank1"), F.min("rank2").alias("rank2"))
    return d.join(df.groupBy(*by).agg(F.sum("label").alias("positives")), list(by))


def base_by_time(df: DataFrame, k: int, by=("bin",)) -> DataFrame:
    """Per time: positives, hits and NDCG of the base Top-k (NDCG 0 without positives); ``df`` has all rows or ``heads``."""
    top = F.col("rank2") <= k
    a = df.groupBy(*by).agg((F.max("positives") if "positives" in df.columns else F.sum("label")).alias("positives"), F.sum(F.when(top, F.col("label")).otherwise(0)).alias("base_hits"),
                            F.sum(F.when(top, F.col("label") * discount(F.col("rank2"))).otherwise(0.0)).alias("_dcg"))
    a = a.withColumn("ideal", F.when(F.col("positives") > 0, ideal(F.col("positives"), k)))
    return a.withColumn("base_ndcg", F.coalesce(F.col("_dcg") / F.col("ideal"), F.lit(0.0))).drop("_dcg")


def gains_by_time(df: DataFrame, base: DataFrame, g: Grid, risk: str, by=("bin",), entity: str = "entity") -> DataFrame:
    """Per time and setting that swaps at all: hits, ndcg (gains over the base list) and swapped."""
    by, most = list(by), max(g.swaps)
    old = df.where((F.col("rank2") <= g.k) & (F.col("rank2") > g.k - most)).select(*by, (F.lit(g.k + 1) - F.col("rank2")).alias("i"), F.col(risk).alias("_old"), F.col("label").alias("_was"))
    pools = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m in g.m for n in g.n])
    able = df.where((F.col("rank2") > g.k) & (F.col("rank1") < F.col("rank2")) & ((F.col("rank2") <= max(g.m)) | (F.col("rank1") <= max(g.n))))
    able = able.select(*by, entity, "label", F.col(risk).alias("_new"), F.explode(F.filter(pools, lambda x: (F.col("rank2") <= x["m"]) | (F.col("rank1") <= x["n"]))).alias("_p"))
    able = able.select(*by, entity, "label", "_new", F.col("_p.m").alias("m"), F.col("_p.n").alias("n"))
    order = Window.partitionBy(*by, "m", "n").orderBy(F.col("_new").desc(), entity)
    new = able.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    met = new.join(old, [*by, "i"]).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in g.ratios])))
    chain = Window.partitionBy(*by, "m", "n", "ratio").orderBy("i")
    met = met.withColumn("_on", F.min(F.when(F.col("_new") >= F.col("ratio") * F.col("_old"), 1).otherwise(0)).over(chain)).where("_on = 1")
    gain = (F.col("label") - F.col("_was")).cast("bigint")
    limits = F.filter(F.array(*[F.lit(s) for s in g.swaps]), lambda s: s >= F.col("i"))
    met = met.select(*by, "m", "n", "ratio", F.explode(limits).alias("swaps"), gain.alias("_g"), (gain * discount(F.lit(g.k + 1) - F.col("i"))).alias("_d"))
    per = met.groupBy(*by, "m", "n", "swaps", "ratio").agg(F.sum("_g").alias("hits"), F.sum("_d").alias("_d"), F.count(F.lit(1)).alias("swapped"))
    return per.join(base.select(*by, "ideal"), by).withColumn("ndcg", F.coalesce(F.col("_d") / F.col("ideal"), F.lit(0.0))).drop("_d", "ideal")


def setting_table(base: DataFrame, gains: DataFrame, g: Grid, group: list[str]) -> DataFrame:
    """Totals of every setting and of the base list (swaps 0) over the times of a group."""
    b = base.groupBy(*group).agg(F.sum("base_hits").alias("base_hits"), F.sum("base_ndcg").alias("base_ndcg"))
    settings = [F.struct(F.lit(m).alias("m"), F.lit(n).alias("n"), F.lit(s).alias("swaps"), F.lit(float(r)).alias("ratio")) for m in g.m for n in g.n for s in g.swaps for r in g.ratios]
    none = F.struct(F.lit(g.fallback[0]).alias("m"), F.lit(g.fallback[1]).alias("n"), F.lit(0).alias("swaps"), F.lit(1.0).alias("ratio"))
    every = b.withColumn("_s", F.explode(F.array(none, *settings))).select(*group, "_s.*", "base_hits", "base_ndcg")
    total = gains.groupBy(*group, "m", "n", "swaps", "ratio").agg(F.sum("hits").alias("_h"), F.sum("ndcg").alias("_n"), F.sum("swapped").alias("_w"))
    d = every.join(total, [*group, "m", "n", "swaps", "ratio"], "left")
    return d.select(*group, "m", "n", "swaps", "ratio", (F.col("base_hits") + F.coalesce("_h", F.lit(0))).alias("hits"),
                    F.round(F.col("base_ndcg") + F.coalesce("_n", F.lit(0.0)), 9).alias("ndcg"), F.coalesce("_w", F.lit(0)).alias("swapped"), "base_hits", F.round("base_ndcg", 9).alias("base_ndcg"))


def choose(settings: DataFrame, group: list[str], gate: Column | None = None) -> DataFrame:
    """More hits than the base list and no lower NDCG (and ``gate``): most hits, then NDCG, fewer swaps,
    the smaller pool, the higher ratio; else the row with swaps 0."""
    good = (F.col("swaps") > 0) & (F.col("hits") > F.col("base_hits")) & (F.col("ndcg") >= F.col("base_ndcg"))
    good = good & gate if gate is not None else good
    d = settings.withColumn("_tier", F.when(good, 0).when(F.col("swaps") == 0, 1).otherwise(2)).where("_tier < 2")
    order = [F.col("_tier"), F.col("hits").desc(), F.col("ndcg").desc(), F.col("swaps"), F.col("m") + F.col("n"), F.col("ratio").desc(), F.col("m")]
    return best_row(d, group, order).withColumn("reason", F.when(F.col("_tier") == 0, "selected").otherwise("no_improvement")).drop("_tier")


def day_bootstrap(days: DataFrame, group: list[str], day: str, value: str, n_days: int, reps: int = 2000, seed: int = 20260905, q: float = 0.05) -> DataFrame:
    """Per group the ``q`` quantile of the resampled sum of ``value`` over ``n_days`` days.

    ``day`` numbers the days of a group from 0; days without a row count 0. The draws are the same
    for every group (paired): ``reps`` x ``n_days`` hashed places, collapsed to multiplicities, meet
    one row a day, so the work grows with groups x days x ``reps`` and not with the data.
    """
    draw = days.sparkSession.range(reps).select(F.col("id").alias("_rep"), F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("_j"))
    draw = draw.groupBy("_rep", F.pmod(mix_hash(seed, "_rep", "_j"), F.lit(n_days)).alias(day)).agg(F.count(F.lit(1)).alias("_w"))
    every = days.select(*group).distinct().join(days.groupBy(*group).agg(F.collect_list(F.struct(day, value)).alias("_days")), group)  # n_days entries
    sums = every.select(*group, F.explode("_days").alias("_d")).select(*group, F.col(f"_d.{day}").alias(day), F.col(f"_d.{value}").alias("_v")).join(draw, day)
    per = sums.groupBy(*group, "_rep").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"))
    # A repetition that draws only days without rows sums to 0.
    full = F.concat(F.collect_list(F.col("_s").cast("double")), F.array_repeat(F.lit(0.0), F.lit(reps) - F.count(F.lit(1)).cast("int")))
    ordered = F.array_sort(full)
    at = q * (reps - 1)
    lo = int(at)
    d = per.groupBy(*group).agg(ordered.alias("_o"))  # ``reps`` numbers
    a, b = F.element_at("_o", lo + 1), F.element_at("_o", min(lo + 2, reps))
    return d.select(*group, (a + (b - a) * (at - lo)).alias("low"))


@dataclass(frozen=True)
class Protocol:
    """Spans in bins of the score table; ``least`` is the number of times each span must have."""

    day: int
    train_days: int = 7
    select_days: int = 7
    lag_hours: int = 36
    least: int = 250
    reps: int = 0
    seed: int = 20260905

    def spans(self, origin: int) -> tuple[int, int, int]:
        """(first bin of the fit, of the selection, end): labels before the end are mature at the origin."""
        end = origin - self.lag_hours * self.day // 24 + 1
        return end - (self.train_days + self.select_days) * self.day, end - self.select_days * self.day, end


def span_table(times: DataFrame, origins: list[int], p: Protocol) -> DataFrame:
    """Per origin the number of times in both spans: one interval join, origins x spans on the small side."""
    spark = times.sparkSession
    rows = [(o, *p.spans(o)) for o in origins]
    o = spark.createDataFrame(rows, "origin bigint, a bigint, b bigint, c bigint")
    day = o.withColumn("_day", F.explode(F.sequence(F.floor(F.col("a") / p.day), F.floor((F.col("c") - 1) / p.day))))
    t = times.select("bin").distinct().withColumn("_day", F.floor(F.col("bin") / p.day))
    j = day.join(t, "_day").where((F.col("bin") >= F.col("a")) & (F.col("bin") < F.col("c")))
    n = j.groupBy("origin").agg(F.count_if(F.col("bin") < F.col("b")).alias("fit_times"), F.count_if(F.col("bin") >= F.col("b")).alias("select_times"))
    return o.select("origin").join(n, "origin", "left").na.fill(0)


def evaluate(df: DataFrame, g: Grid, p: Protocol, risk: str, origin: int) -> tuple[DataFrame, DataFrame]:
    """(all settings, the chosen one) of the selection span of an origin; ``risk`` scores its rows."""
    _, b, end = p.spans(origin)
    d = df.where((F.col("bin") >= b) & (F.col("bin") < end))
    base = base_by_time(d, g.k)
    gains = materialize(gains_by_time(d, base, g, risk), "swap-gains")
    settings = setting_table(base, gains, g, [])
    if not p.reps:
        return settings, choose(settings, [])
    keys = ["m", "n", "swaps", "ratio"]
    days = gains.groupBy(*keys, F.floor((F.col("bin") - b) / p.day).alias("_day")).agg(F.sum("hits").alias("hits"))
    low = day_bootstrap(days, keys, "_day", "hits", p.select_days, p.reps, p.seed)
    settings = settings.join(low, keys, "left").withColumn("low", F.coalesce("low", F.lit(0.0)))
    return settings, choose(settings, [], F.col("low") > 0)


def rerank_walk(df: DataFrame, origins: list[tuple[int, int]], g: Grid, p: Protocol) -> tuple[DataFrame, DataFrame]:
    """Meta re-ranker over rolling origins: (one row per origin, reranked rows of every segment).

    ``df``: entity, bin, label, rank1, rank2 and ``models.RERANK``, cheap to read several times (spans of it are not written again). Per origin a logistic model is
    fitted on the older days, settings are chosen on the newer days by its risk, and the segment is
    reordered by the chosen setting; without enough times or without an improvement the base order
    stays. The loop runs over origins; each step is a set of Spark jobs.
    """
    spark = df.sparkSession
    df = df.select("entity", "bin", "label", "rank1", "rank2", *Mo.RERANK)
    counts = {r["origin"]: r for r in span_table(df, [o for o, _ in origins], p).collect()}
    rows, parts = [], []
    for o, end in origins:
        a, b, c = p.spans(o)
        n, seg = counts[o], df.where((F.col("bin") >= o) & (F.col("bin") < end))
        pick, optimal, model = None, None, None
        if min(n["fit_times"], n["select_times"]) >= p.least:
            train = df.where((F.col("bin") >= a) & (F.col("bin") < b))
            size = train.count()
            model = Mo.fit(Mo.logistic(Mo.RERANK, weighted=False, reg=1.0 / size, iters=100), train)
            if not isinstance(model, Mo.ConstantPrior):
                scored = Mo.score(model, df.where((F.col("bin") >= b) & (F.col("bin") < c)), "risk")
                pick = evaluate(scored, g, p, "risk", o)[1].first()
                optimal = Mo.plain_gradient(model, train)
        swaps = pick["swaps"] if pick else 0
        m, k = (pick["m"], pick["n"]) if pick else g.fallback
        out = Mo.score(model, seg, "risk") if swaps else seg.withColumn("risk", F.col("m_r2"))
        out = swap_tail(out, g.k, m, k, swaps, pick["ratio"] if swaps else 1.0, "risk")
        parts.append(out.select(F.lit(o).cast("bigint").alias("origin"), "entity", "bin", "label", "rank2", "position", "in_top"))
        rows.append((o, n["fit_times"], n["select_times"], pick["reason"] if pick else "insufficient", m, k, swaps, float(pick["ratio"]) if pick else 1.0,
                     *((pick["base_hits"], pick["hits"], pick["base_ndcg"], pick["ndcg"]) if pick else (None,) * 4), optimal))
    schema = "origin bigint, fit_times bigint, select_times bigint, reason string, m int, n int, swaps int, ratio double, base_hits bigint, hits bigint, base_ndcg double, ndcg double, gradient double"
    done = parts[0]
    for x in parts[1:]:
        done = done.unionByName(x)
    return spark.createDataFrame(rows, schema), done
