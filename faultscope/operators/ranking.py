"""Ranks, Top-K, tail swaps and list stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import score_chunk
from ..session import materialize
from .scan import sequence_number


def rank_window(score: str, by=("bin",), tie: str = "entity"):
    return Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))


def risk_rank(df: DataFrame, score: str, by=("bin",), tie: str = "entity", name: str = "rank") -> DataFrame:
    """1..N per decision time, ties in entity order.

    A two-level scan over score chunks: a time that holds a large share of all
    rows is ranked by many tasks. For the head of the list use ``topk``.
    """
    d = df.withColumn("_neg", -F.col(score))
    return sequence_number(d, list(by), ["_neg", tie], score_chunk("_neg"), name).drop("_neg")


def topk(df: DataFrame, score: str, k: int, by=("bin",), tie: str = "entity", name: str = "rank") -> DataFrame:
    """``rank <= k``; Spark prunes each map task to k rows per time before the shuffle."""
    return df.withColumn(name, F.row_number().over(rank_window(score, by, tie))).where(F.col(name) <= k)


def top_fraction(df: DataFrame, score: str, f: float, by=("bin",), tie: str = "entity") -> DataFrame:
    """``max(1, ceil(n * f))`` rows per time."""
    sizes = df.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(f))).alias("_k"))
    return risk_rank(df, score, by, tie).join(sizes, list(by)).where(F.col("rank") <= F.col("_k")).drop("_k")


def rank_mean(df: DataFrame, scores: list[str], by=("bin",), tie: str = "entity", name: str = "rank_mean") -> DataFrame:
    """Mean over models of ``(n - rank0) / n``."""
    d = df.join(df.groupBy(*by).agg(F.count("*").alias("_n")), list(by))
    for i, sc in enumerate(scores):
        d = risk_rank(d, sc, by, tie, f"_r{i}")
    parts = [(F.col("_n") - F.col(f"_r{i}") + 1) / F.col("_n") for i in range(len(scores))]
    return d.withColumn(name, reduce(lambda a, b: a + b, parts) / len(parts)).drop("_n", *[f"_r{i}" for i in range(len(scores))])


def intersect_topk(df: DataFrame, scores: list[str], f: float, by=("bin",), tie: str = "entity") -> DataFrame:
    """Rows inside the top fraction of every model."""
    sizes = df.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(f))).alias("_k"))
    d = df
    for i, s in enumerate(scores):
        d = risk_rank(d, s, by, tie, f"_r{i}")
    d = d.join(sizes, list(by))
    keep = reduce(lambda a, b: a & b, [F.col(f"_r{i}") <= F.col("_k") for i in range(len(scores))])
    return d.where(keep).drop("_k", *[f"_r{i}" for i in range(len(scores))])


def topk_overlap(a: DataFrame, b: DataFrame, by=("bin",), tie: str = "entity", rank: str = "rank") -> DataFrame:
    """Intersection size and identical positions per time."""
    keys = [*by, tie]
    l, r = a.select(*keys, F.col(rank).alias("_ra")), b.select(*keys, F.col(rank).alias("_rb"))
    return l.join(r, keys).groupBy(*by).agg(F.count("*").alias("overlap"), F.count_if(F.col("_ra") == F.col("_rb")).alias("same_position"))


def topk_churn(top: DataFrame, step: int, entity: str = "entity", bin_col: str = "bin") -> DataFrame:
    """New members per time against the previous contiguous time."""
    w = Window.partitionBy(entity).orderBy(bin_col)
    d = top.withColumn("_stay", F.when(F.lag(bin_col).over(w) == F.col(bin_col) - step, 1).otherwise(0))
    per = d.groupBy(bin_col).agg(F.count("*").alias("members"), F.sum("_stay").alias("stayed"))
    prev = per.select((F.col(bin_col) + step).alias(bin_col))
    return per.join(prev, bin_col, "left_semi").select(bin_col, "members", (F.col("members") - F.col("stayed")).alias("entered"))


def candidate_union(df: DataFrame, m: int, n: int, base_rank: str = "rank2", challenger_rank: str = "rank1") -> DataFrame:
    return df.where((F.col(base_rank) <= m) | (F.col(challenger_rank) <= n))


def swap_tail(df: DataFrame, k: int, m: int, n: int, swaps: int, ratio: float, risk: str, by=("bin",), entity: str = "entity") -> DataFrame:
    """Replace the tail of the base Top-K by the best challengers.

    Challengers are candidates (base rank <= m or challenger rank <= n) outside the
    Top-K whose challenger rank beats their base rank, best risk first. The i-th
    challenger meets slot ``k + 1 - i``; the chain stops at the first meeting with
    ``risk_new < ratio * risk_old``, and after ``swaps`` meetings. Returns the full
    order: ``position`` and ``in_top``.
    """
    by = list(by)
    if swaps <= 0:
        return df.withColumn("in_top", F.col("rank2") <= k).withColumn("position", F.col("rank2"))
    # All rows that can take part, at most k + m + n a time: the swap list is worked out in one row.
    near = (F.col("rank2") <= m) | (F.col("rank1") <= n)
    heads = df.where(near | (F.col("rank2") <= k)).groupBy(*by).agg(F.collect_list(F.struct(
        F.col(entity).alias("e"), F.col("rank1").alias("r1"), F.col("rank2").alias("r2"), F.col(risk).alias("risk"), near.alias("near"))).alias("_h"))
    ordered = lambda keep, key: F.sort_array(F.transform(F.filter("_h", keep), lambda x: F.struct(key(x).alias("o"), x["e"].alias("e"), x["r2"].alias("r2"), x["risk"].alias("risk"))))
    new = ordered(lambda x: x["near"] & (x["r2"] > k) & (x["r1"] < x["r2"]), lambda x: -x["risk"])
    old = ordered(lambda x: (x["r2"] <= k) & (x["r2"] > k - swaps), lambda x: -x["r2"])
    met = heads.withColumn("_z", F.arrays_zip(F.slice(new, 1, swaps).alias("n"), old.alias("o")))
    ok = F.transform("_z", lambda x: F.coalesce(x["n"]["risk"] >= F.lit(ratio) * x["o"]["risk"], F.lit(False)))
    met = met.withColumn("_first", F.array_position(ok, False))
    met = met.select(*by, F.when(F.col("_first") > 0, F.slice("_z", F.lit(1), (F.col("_first") - 1).cast("int"))).otherwise(F.col("_z")).alias("_z"))
    # A row a time, written so that its size is known: else all rows are shuffled to meet it.
    d = df.join(materialize(met, "swaps"), by, "left")
    r = F.col("rank2")
    out = F.exists("_z", lambda x: x["o"]["e"] == F.col(entity))
    d = d.withColumns({"_slot": F.get(F.transform(F.filter("_z", lambda x: x["n"]["e"] == F.col(entity)), lambda x: x["o"]["r2"]), F.lit(0)), "_gone": F.coalesce(out, F.lit(False))})
    ahead = lambda side: F.coalesce(F.size(F.filter("_z", lambda x: x[side]["r2"] < r)), F.lit(0))
    in_top = F.col("_slot").isNotNull() | (~F.col("_gone") & (r <= k))
    pos = (F.when(F.col("_slot").isNotNull(), F.col("_slot")).when(F.col("_gone"), F.lit(k + 1) + ahead("o"))
           .when(r <= k, r).otherwise(r + F.coalesce(F.size("_z"), F.lit(0)) - ahead("n")))
    return d.withColumn("in_top", in_top).withColumn("position", pos).drop("_slot", "_gone", "_z")


def promote(candidates: DataFrame, baseline: DataFrame, kind: str, ap: str, recall: str, name: str, gain: float, tolerance: float, tie: float = 1e-12) -> DataFrame:
    """The candidates with their deltas to the baseline of their kind, the two gate tests and the choice.

    A candidate passes with an AP gain above ``gain`` and a recall loss of at most ``tolerance``.
    Chosen is the passing one with the highest AP; within ``tie`` of it the higher recall,
    then the first name. One row per candidate: a handful, whatever the data.
    """
    b = baseline.select(kind, F.col(ap).alias("_ap"), F.col(recall).alias("_recall"))
    d = candidates.join(b, kind).withColumns({"ap_delta": F.col(ap) - F.col("_ap"), "recall_delta": F.col(recall) - F.col("_recall")}).drop("_ap", "_recall")
    d = d.withColumns({"passes_ap": F.col("ap_delta") > gain, "passes_recall": F.col("recall_delta") >= -tolerance})
    d = d.withColumn("eligible", F.col("passes_ap") & F.col("passes_recall"))
    top = d.where("eligible").agg(F.max(ap)).scalar()
    rank = F.struct(F.when(F.col("eligible") & (F.col(ap) >= top - tie), 0).otherwise(1), -F.col(recall), F.col(name))
    best = d.where("eligible").agg(F.min_by(name, rank)).scalar()
    return d.withColumn("chosen", F.coalesce(F.col("eligible") & (F.col(name) == best), F.lit(False)))


def best_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(1)).orderBy(*order)
    return df.withColumn("_b", F.row_number().over(w)).where(F.col("_b") == 1).drop("_b")


def select_params(metrics: DataFrame, group: list[str], is_base: Column) -> DataFrame:
    """More hits than the base and no lower NDCG; most hits, then NDCG, then fewer swaps; else the base row."""
    w = Window.partitionBy(*group)
    d = metrics.withColumn("_base", is_base)
    d = d.withColumn("_bh", F.max(F.when(F.col("_base"), F.col("hits"))).over(w)).withColumn("_bn", F.max(F.when(F.col("_base"), F.col("ndcg"))).over(w))
    good = (F.col("hits") > F.col("_bh")) & (F.col("ndcg") >= F.col("_bn"))
    d = d.withColumn("_tier", F.when(good, 0).when(F.col("_base"), 1).otherwise(2)).where(F.col("_tier") < 2)
    return best_row(d, group, [F.col("_tier"), F.col("hits").desc(), F.col("ndcg").desc(), F.col("swaps"), F.col("m"), F.col("n")]).drop("_base", "_bh", "_bn", "_tier")
