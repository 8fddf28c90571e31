"""Connected components by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Hang every larger neighbour (``both``) or every smaller one under the least of the neighbourhood."""
    e = edges.union(edges.select("v", "u")) if both else edges
    # Written, so that the join has plain shuffles on both sides and Spark can split a hub's rows.
    least = stored(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    near = e.join(least, "u")
    if both:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every u that is not the least of its component; edges (u, v) are longs.

    Joins and aggregates combine map-side and hold one row for each hub on the small side, so a
    hub with very many neighbours is split by Spark. Rounds grow with the logarithm of the
    longest path. NULL and self edges are dropped.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    seen = tuple(now.agg(*print_of).first())
    while seen[0]:
        now = stored(_stars(_stars(now, True), False), "stars")
        was, seen = seen, tuple(now.agg(*print_of).first())
        if was == seen:
            break
    return now.select("u", F.col("v").alias("root"))
