"""Ordered scans in two levels, so that one hot key never fills one task.

A plain ``partitionBy(key).orderBy(t)`` window sends all rows of a key to one
task. Here rows are windowed per ``(key, chunk)``, where the chunk is a coarse
monotone function of the order column; one summary row per chunk carries the
state from earlier chunks. The carried table has as many rows as there are
chunks, and the join back uses the ``(key, chunk)`` partitioning the window
already produced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    run: dict[str, tuple] | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Several ordered outputs in one pass over ``keys`` x ``order``.

    ``run``  ``{out: (kind, expr)}`` or ``(kind, expr, 'before')`` for the rows strictly before;
    ``lag`` / ``lead``  ``{out: column}`` of the previous / next row.
    """
    run, lag, lead = run or {}, lag or {}, lead or {}
    src = df.withColumn("_chunk", chunk)
    for n, spec in run.items():
        src = src.withColumn(f"_in_{n}", spec[1])
    by = ["_key"] if keys else []  # one struct: NULL keys meet in the join below as they do in a window
    if keys:
        src = src.withColumn("_key", F.struct(*keys))
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    local, edge, carry, out = [], [], [], []
    cw = Window.partitionBy(*by).orderBy("_chunk")
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    for n, spec in run.items():
        kind, strict = spec[0], len(spec) > 2
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        local.append(_AGG[kind](f"_in_{n}").over(frame).alias(f"_loc_{n}"))
        edge.append(_AGG[kind](f"_in_{n}").alias(f"_edge_{n}"))
        carry.append(_AGG[kind](f"_edge_{n}").over(before).alias(f"_car_{n}"))
        out.append(_merge(kind, F.col(f"_loc_{n}"), F.col(f"_car_{n}")).alias(n))
    for cols, step, pick, tag in ((lag, F.lag, F.max_by, "p"), (lead, F.lead, F.min_by, "n")):
        if not cols:
            continue
        one = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
        local.append(step(one).over(w).alias(f"_loc__{tag}"))
        edge.append(pick(one, F.struct(*order)).alias(f"_edge__{tag}"))
        carry.append(step(f"_edge__{tag}").over(cw).alias(f"_car__{tag}"))
        both = F.coalesce(F.col(f"_loc__{tag}"), F.col(f"_car__{tag}"))
        out += [both[o].alias(o) for o in cols]
    rows = src.select("*", *local)
    edges = src.groupBy(*by, "_chunk").agg(*edge).select(*by, "_chunk", *carry)
    return rows.join(edges, [*by, "_chunk"], "left").select(*[F.col(c) for c in df.columns], *out)


def running(df, keys, order, chunk, outputs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running sum/max/min per key; ``outputs`` is ``{name: (kind, expr)}``."""
    spec = {n: (k, e) if inclusive else (k, e, "before") for n, (k, e) in outputs.items()}
    return scan(df, keys, order, chunk, run=spec)


def with_neighbour(df, keys, order, chunk, cols: dict[str, str], following: bool = False) -> DataFrame:
    """``lag`` (or ``lead``) of columns across chunk borders; ``cols`` is ``{output: input}``."""
    return scan(df, keys, order, chunk, lead=cols) if following else scan(df, keys, order, chunk, lag=cols)


def sequence_number(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "seq") -> DataFrame:
    """1-based ``row_number`` that also works for one global order (``keys=[]``)."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("bigint"))})


def segments(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    starts: Callable[[Column, Column], Column],
    name: str = "segment",
    prev: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Number the segments of an ordered key in one pass.

    ``starts(previous, current)`` gets the two rows as structs and says whether a
    segment begins; the first row of a key always begins one. Inside a chunk the
    first row is left open; its flag is settled on the chunk summaries.
    """
    prev, lead = prev or {}, lead or {}
    row = F.struct(*[F.col(c) for c in df.columns])
    by = ["_key"] if keys else []
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    src = df.withColumn("_chunk", chunk).withColumn("_cur", row)
    if keys:
        src = src.withColumn("_key", F.struct(*keys))
    local = src.withColumn("_prev", F.lag("_cur").over(w))
    if lead:
        local = local.withColumn("_next", F.lead(F.struct(*[F.col(c).alias(o) for o, c in lead.items()])).over(w))
    flag = F.when(F.col("_prev").isNull(), 0).when(starts(F.col("_prev"), F.col("_cur")), 1).otherwise(0)
    local = local.withColumn("_new", flag.cast("bigint")).withColumn("_loc", F.sum("_new").over(run))
    key = F.struct(*order)
    edges = local.groupBy(*by, "_chunk").agg(
        F.min_by("_cur", key).alias("_first"), F.max_by("_cur", key).alias("_last"), F.sum("_new").alias("_n"))
    cw = Window.partitionBy(*by).orderBy("_chunk")
    edges = edges.withColumn("_plast", F.lag("_last").over(cw)).withColumn("_nfirst", F.lead("_first").over(cw))
    edges = edges.withColumn(
        "_open", F.when(F.col("_plast").isNull(), 1).when(starts(F.col("_plast"), F.col("_first")), 1).otherwise(0).cast("bigint"))
    edges = edges.withColumn("_base", F.sum(F.col("_open") + F.col("_n")).over(cw.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    carry = edges.select(
        *by, "_chunk", "_base", F.struct(*[F.col("_plast")[c].alias(c) for c in prev.values()] or [F.lit(1).alias("x")]).alias("_pc"),
        F.col("_plast").isNotNull().alias("_has"),
        *([F.when(F.col("_nfirst").isNotNull(), F.struct(*[F.col("_nfirst")[c].alias(o) for o, c in lead.items()])).alias("_nc")] if lead else []))
    out = [(F.col("_base") + F.col("_loc")).alias(name)]
    for o, c in prev.items():
        out.append(F.when(F.col("_prev").isNotNull(), F.col("_prev")[c]).when(F.col("_has"), F.col("_pc")[c]).alias(o))
    if lead:
        both = F.coalesce(F.col("_next"), F.col("_nc"))
        out += [both[o].alias(o) for o in lead]
    return local.join(carry, [*by, "_chunk"], "left").select(*[F.col(c) for c in df.columns], *out)
