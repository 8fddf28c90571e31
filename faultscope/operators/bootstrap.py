"""Resampling with hashed draws that any SQL engine reproduces.

A resampled median needs no resampled units: it is the value at the middle ranks of ``n``
uniform draws from ``1..n``. So draws are made in the order of the values, the middle ranks
are found from counts per rank cell, and only two ranks a repetition are looked up. Draws
are generated and counted inside a task and never leave it; no unit is multiplied by the
repetitions, and no group has its values in one buffer. (A mean needs every drawn value;
there the collapsed draws do travel.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import idiv, mix_hash, score_chunk
from ..session import materialize
from .joins import asof
from .scan import running, sequence_number

#: Draws one generated row stands for; rank cells of a size; draws a task should make.
RUN, CELLS, PER_TASK = 1 << 16, 1024, 1 << 24


def middle_ranks(sizes: DataFrame, reps: int, seed: int, cells: int = CELLS, run: int = RUN) -> DataFrame:
    """Per size ``_n`` and repetition the lower and upper middle rank of ``_n`` draws from ``1.._n``.

    Draw ``i`` of a repetition is ``mix_hash(seed, rep, i) % _n + 1``. One pass counts the draws
    per cell of ``ceil(_n / cells)`` ranks, which finds the cells of both middles; a second pass
    makes the draws again and counts those cells rank by rank. Sizes up to 2^31 - 1.
    """
    total, = sizes.agg(F.sum("_n")).first()
    tasks = max(1, min(50_000, (total or 0) * reps // PER_TASK + 1), sizes.sparkSession.sparkContext.defaultParallelism)
    runs = (sizes.select("_n", F.ceil(F.col("_n") / cells).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep"))
            .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), F.lit(run).cast("bigint")))))

    def draws(at: DataFrame) -> DataFrame:
        # By number: a row is small and its draws are many, which adaptive coalescing cannot see.
        i = at.repartition(tasks, "_n", "_rep", "_from").withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + F.lit(run - 1)))))
        return i.withColumn("_rank", F.pmod(mix_hash(seed, "_rep", "_i"), F.col("_n")) + 1).withColumn("_cell", idiv(F.col("_rank") - 1, F.col("_w")))

    low, high = idiv(F.col("_n") + 1, 2), idiv(F.col("_n"), 2) + 1
    one = Window.partitionBy("_n", "_rep")

    def reach(counts: DataFrame, place: str, by: Window) -> DataFrame:
        """``_a`` and ``_b``: the first ``place`` with as many draws up to it as the middles ask for."""
        upto = counts.withColumn("_cum", F.sum("_c").over(by.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
        return upto.groupBy("_n", "_rep").agg(
            F.min(F.when(F.col("_cum") >= low, F.col(place))).alias("_a"), F.min(F.when(F.col("_cum") >= high, F.col(place))).alias("_b"),
            *([F.max(F.when(F.col("_cum") < low, F.col("_cum"))).alias("_under_a"), F.max(F.when(F.col("_cum") < high, F.col("_cum"))).alias("_under_b")] if place == "_cell" else []))

    coarse = draws(runs).groupBy("_n", "_rep", "_cell").agg(F.count("*").alias("_c")).withColumn("_before", F.lit(0))
    at = materialize(reach(coarse, "_cell", one), "bootstrap-cells")
    # Both middles lie in one cell or in two neighbours among those that have draws.
    goal = at.select("_n", "_rep", F.explode(F.array_distinct(F.array(
        F.struct(F.col("_a").alias("_cell"), F.coalesce("_under_a", F.lit(0)).alias("_before")),
        F.struct(F.col("_b").alias("_cell"), F.coalesce("_under_b", F.lit(0)).alias("_before"))))).alias("_g")).select("_n", "_rep", "_g.*")
    wanted = draws(runs.join(at.select("_n", "_rep", "_a", "_b"), ["_n", "_rep"])).where("_cell = _a OR _cell = _b")
    fine = wanted.groupBy("_n", "_rep", "_cell", "_rank").agg(F.count("*").alias("_c")).join(goal, ["_n", "_rep", "_cell"])
    return reach(fine, "_rank", Window.partitionBy("_n", "_rep", "_cell")).withColumnsRenamed({"_a": "_low", "_b": "_high"})


def bootstrap_ci(df: DataFrame, group: list[str], value: str, reps: int = 1000, seed: int = 42, stat: str = "median",
                 width: int = 1 << 20, cells: int = CELLS, run: int = RUN) -> DataFrame:
    """2.5 % / 97.5 % limits of the median or mean over resampled units, a unit a row.

    Units are numbered by value in their group (those of equal value are interchangeable); units without a value do not count, and a group without any has no row.
    NULL is a group of its own.

    ``median``: equal values are counted first, so a hot value is one row, and the middle ranks of
    each repetition (``middle_ranks``, shared by groups of one size) are looked up in the running
    counts. ``mean`` needs every drawn value: draws are collapsed to (repetition, rank, times) and
    joined with the values by rank.
    """
    d = df.where(F.col(value).isNotNull()).select(F.struct(*group).alias("_g") if group else F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v"))
    counts = d.groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    cum = materialize(running(counts, ["_g"], ["_v"], score_chunk("_v"), {"_cum": ("sum", F.col("_c"))}), "bootstrap-values")
    size = cum.groupBy("_g").agg(F.max("_cum").alias("_n"))
    if stat == "median":
        mid = middle_ranks(size.select("_n").distinct(), reps, seed, cells, run)
        ask = size.join(mid, "_n").select("_g", "_rep", F.explode(F.array("_low", "_high")).alias("_rank"))
        got = asof(ask, cum.select("_g", "_cum", "_v"), ["_g"], "_rank", "_cum", {"_v": "_v"}, width=width, forward=True, until=F.lit(1))
        per = got.groupBy("_g", "_rep").agg(F.avg("_v").alias("_s"))
    else:
        rows = cum.select("_g", "_v", F.explode(F.sequence(F.col("_cum") - F.col("_c") + 1, "_cum")).alias("_rank"))
        draw = rows.select("_g", "_rank").join(size, "_g").withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        idx = F.pmod(mix_hash(seed, "_rep", "_rank"), F.col("_n")) + 1
        times = draw.select("_g", "_rep", idx.alias("_rank")).groupBy("_g", "_rep", "_rank").agg(F.count("*").alias("_w"))
        per = times.join(rows, ["_g", "_rank"]).groupBy("_g", "_rep").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_s"))
    q = F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975)))
    out = per.groupBy("_g").agg(q[0].alias("ci_low"), q[1].alias("ci_high"))
    return out.select(*[F.col("_g")[g].alias(g) for g in group], "ci_low", "ci_high")


def block_bootstrap(df: DataFrame, order: str, block: int, reps: int, sums: dict[str, F.Column], seed: int = 42, width: int = 1 << 20) -> DataFrame:
    """Moving non-circular blocks over ordered units; per repetition the sums of the given columns.

    ``ceil(n / block)`` blocks start at hashed places and are cut to ``n`` units. Every block that
    can start is summed once, whole and as the cut last one; a repetition adds up its blocks, so
    units are multiplied by ``block`` and not by the repetitions.
    """
    d = sequence_number(df, [], [order], idiv(order, width), "_pos").withColumns({f"_v_{s}": c for s, c in sums.items()})
    d = materialize(d.select("_pos", *[f"_v_{s}" for s in sums]), "bootstrap-units")
    n = d.agg(F.max("_pos")).first()[0] or 0
    blocks = -(-n // block)
    last = n - (blocks - 1) * block
    at = F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("_pos") - block), F.col("_pos") - 1))
    each = d.withColumn("_s", at).withColumn("_cut", F.explode(F.array(F.lit(False), F.lit(True))))
    each = each.where(F.col("_pos") - F.col("_s") <= F.when(F.col("_cut"), last).otherwise(block))
    starts = each.groupBy("_s", "_cut").agg(F.count("*").alias("_u"), *[F.sum(f"_v_{s}").alias(f"_v_{s}") for s in sums])
    draws = df.sparkSession.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")) if n else \
        df.sparkSession.range(0).select(F.col("id").alias("rep"), F.lit(0).alias("_b"))
    draws = draws.select("rep", (F.col("_b") == blocks - 1).alias("_cut"), F.pmod(mix_hash(seed, "rep", "_b"), F.lit(max(n - block + 1, 1))).alias("_s"))
    picks = draws.groupBy("rep", "_s", "_cut").agg(F.count("*").alias("_w"))
    return picks.join(starts, ["_s", "_cut"]).groupBy("rep").agg(
        F.sum(F.col("_u") * F.col("_w")).alias("units"), *[F.sum(F.col(f"_v_{s}") * F.col("_w")).alias(s) for s in sums])
