"""Time-aware joins: as-of, interval, window-count, without pair explosion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import DAY, idiv


@dataclass(frozen=True)
class Source:
    """One right side of an as-of join: ``payload`` maps output names to its columns."""

    df: DataFrame
    time: str | Column
    payload: dict[str, str]
    inclusive: bool = True


def asof_multi(
    left: DataFrame,
    sources: list[Source],
    keys: list[str],
    left_time: str | Column,
    width: int = DAY,
    forward: bool = False,
    until: Column | None = None,
) -> DataFrame:
    """Attach, per source, the nearest row at or before (``forward``: after) the left time.

    Left rows, source rows and carry rows are united and swept once per
    ``(keys, time chunk)``. A carry row repeats the last source row of a chunk at
    the start of each following chunk up to the next one that has its own, so no
    join is needed and the left side is read and shuffled exactly once whatever
    the number of sources or matches. ``until`` is the last left time; pass it
    when the left plan is expensive, otherwise it is a scalar subquery.
    """
    sign = -1 if forward else 1
    lt = F.lit(sign) * (left_time if isinstance(left_time, Column) else F.col(left_time))
    if until is None:
        until = left.agg(F.max(lt)).scalar()
    else:
        until = F.lit(sign) * until
    last_chunk = idiv(until, width)
    u = left.select(*keys, lt.alias("_t"), F.lit(1).alias("_kind"), F.struct("*").alias("_row")).withColumn("_chunk", idiv("_t", width))
    for i, s in enumerate(sources):
        st = F.lit(sign) * (s.time if isinstance(s.time, Column) else F.col(s.time))
        pay = F.struct(st.alias("_o"), *[F.col(c).alias(o) for o, c in s.payload.items()]).alias(f"_p{i}")
        r = s.df.select(*keys, st.alias("_t"), F.lit(0 if s.inclusive else 2).alias("_kind"), pay).withColumn("_chunk", idiv("_t", width))
        edge = r.groupBy(*keys, "_chunk").agg(F.max(f"_p{i}").alias(f"_p{i}"))
        nxt = F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
        edge = edge.withColumn("_hi", F.coalesce(nxt, last_chunk)).where(F.col("_hi") > F.col("_chunk"))
        carry = edge.select(*keys, F.explode(F.sequence(F.col("_chunk") + 1, F.col("_hi"))).alias("_chunk"), f"_p{i}")
        carry = carry.withColumn("_t", F.col("_chunk") * F.lit(width)).withColumn("_kind", F.lit(-1))
        u = u.unionByName(r, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    pcols = [f"_p{i}" for i in range(len(sources))]
    w = (Window.partitionBy(*keys, "_chunk").orderBy("_t", "_kind", *pcols)
         .rowsBetween(Window.unboundedPreceding, 0))
    swept = u.select("_row", *[F.last(p, ignorenulls=True).over(w).alias(p) for p in pcols]).where(F.col("_row").isNotNull())
    return swept.select("_row.*", *[F.col(f"_p{i}")[o].alias(o) for i, s in enumerate(sources) for o in s.payload])


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str | Column,
    right_time: str,
    payload: dict[str, str],
    width: int = DAY,
    inclusive: bool = True,
    forward: bool = False,
    until: Column | None = None,
) -> DataFrame:
    """As-of join with one source."""
    return asof_multi(left, [Source(right, right_time, payload, inclusive)], keys, left_time, width, forward, until)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    t: str,
    lo: str,
    hi: str,
    width: int,
    closed: str = "left",
) -> DataFrame:
    """Rows of ``points`` inside ``[lo, hi)`` (or ``both``/``right`` closed) of an interval.

    A range condition alone would be a nested loop; each interval is listed under
    the fixed-width time buckets it touches, which gives an equi-join on
    ``(keys, bucket)``. Pick ``width`` near the interval length (two buckets each).
    """
    iv = intervals.withColumn("_b", F.explode(F.sequence(idiv(lo, width), idiv(hi, width))))
    pt = points.withColumn("_b", idiv(t, width))
    joined = pt.join(iv, [*keys, "_b"])
    lower = F.col(t) > F.col(lo) if closed == "right" else F.col(t) >= F.col(lo)
    upper = F.col(t) < F.col(hi) if closed == "left" else F.col(t) <= F.col(hi)
    return joined.where(lower & upper).drop("_b")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, width: int = 7 * DAY) -> DataFrame:
    """Union of intervals per key; touching intervals (``next start <= end``) merge."""
    from .scan import running

    d = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).distinct()
    chunk = idiv("start", width)
    prev = running(d, keys, ["start", "end"], chunk, {"_reach": ("max", F.col("end"))}, inclusive=False)
    flagged = prev.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0))
    ids = running(flagged, keys, ["start", "end"], chunk, {"island": ("sum", F.col("_new").cast("bigint"))})
    return ids.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members"))


def sweep(
    left: DataFrame,
    entries: DataFrame,
    keys: list[str],
    left_time: Column,
    values: dict[str, str],
    width: int,
    until: Column | None = None,
) -> DataFrame:
    """Running ``sum`` or ``max`` of entry values at each left time.

    ``entries`` holds ``keys, _t, _kind`` (0 = visible at equal times, 2 = only
    later) and the value columns; ``values`` maps a column to ``sum`` or ``max``.
    Left rows, entries and one carry row per following chunk are united and swept
    once per ``(keys, chunk)``: the left side is shuffled once and never paired.
    """
    fn = {"sum": F.sum, "max": F.max}
    if until is None:
        until = left.agg(F.max(left_time)).scalar()
    last_chunk = idiv(until, width)
    u = left.select(*keys, left_time.alias("_t"), F.lit(1).alias("_kind"), F.struct("*").alias("_row")).withColumn("_chunk", idiv("_t", width))
    e = entries.withColumn("_chunk", idiv("_t", width))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    tot = e.groupBy(*keys, "_chunk").agg(*[fn[k](v).alias(v) for v, k in values.items()])
    tot = tot.select(*keys, "_chunk", *[fn[k](v).over(upto).alias(v) for v, k in values.items()],
                     F.coalesce(F.lead("_chunk").over(w), last_chunk).alias("_hi")).where(F.col("_hi") > F.col("_chunk"))
    carry = tot.select(*keys, F.explode(F.sequence(F.col("_chunk") + 1, F.col("_hi"))).alias("_chunk"), *values)
    carry = carry.withColumn("_t", F.col("_chunk") * F.lit(width)).withColumn("_kind", F.lit(-1))
    u = u.unionByName(e, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = u.select("_row", *[fn[k](v).over(order).alias(v) for v, k in values.items()]).where(F.col("_row").isNotNull())
    return swept.select("_row.*", *values)


def not_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str = "start", end: str = "end",
                     width: int = DAY, until: Column | None = None) -> DataFrame:
    """Points outside every interval (both ends inclusive).

    A point is blocked exactly when the farthest end among the intervals that
    started at or before it reaches it, so one sweep decides; intervals may overlap.
    """
    e = intervals.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.col(end).alias("_reach"))
    d = sweep(points, e, keys, F.col(t), {"_reach": "max"}, width, until)
    return d.where(F.col("_reach").isNull() | (F.col("_reach") < F.col(t))).drop("_reach")


def event_counts(
    left: DataFrame,
    events: DataFrame,
    keys: list[str],
    cutoff: str | Column,
    event_time: str,
    spans: dict[str, int | None],
    width: int = DAY,
    right_inclusive: bool = True,
    until: Column | None = None,
) -> DataFrame:
    """Events in ``[cutoff - span, cutoff]`` per span (``None`` = lifetime).

    An event adds one when it enters (at ``e``) and takes one away when it leaves a
    span (just after ``e + span``); a count is the running sum at the cutoff.
    """
    cut = cutoff if isinstance(cutoff, Column) else F.col(cutoff)
    names = list(spans)

    def entry(at, kind, deltas):
        return F.struct(at.alias("_t"), F.lit(kind).alias("_kind"), *[F.lit(deltas.get(n, 0)).cast("bigint").alias(f"_d_{n}") for n in names])

    et = F.col(event_time)
    marks = [entry(et, 0 if right_inclusive else 2, {n: 1 for n in names})]
    marks += [entry(et + F.lit(s), 2, {n: -1}) for n, s in spans.items() if s is not None]
    e = events.select(*keys, F.explode(F.array(*marks)).alias("_m")).select(*keys, "_m.*")
    d = sweep(left, e, keys, cut, {f"_d_{n}": "sum" for n in names}, width, until)
    return d.select(*left.columns, *[F.coalesce(f"_d_{n}", F.lit(0).cast("bigint")).alias(n) for n in names])


def align(a: DataFrame, b: DataFrame, keys: list[str], cols_a: dict[str, str], cols_b: dict[str, str]) -> DataFrame:
    """Full outer alignment of two runs with presence flags."""
    l = a.select(*keys, *[F.col(c).alias(o) for o, c in cols_a.items()], F.lit(1).alias("in_a"))
    r = b.select(*keys, *[F.col(c).alias(o) for o, c in cols_b.items()], F.lit(1).alias("in_b"))
    return l.join(r, keys, "full_outer").withColumn("in_a", F.coalesce("in_a", F.lit(0))).withColumn("in_b", F.coalesce("in_b", F.lit(0)))


def alignment_violations(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("in_b") == 0).alias("only_a"),
        F.count_if(F.col("in_a") == 0).alias("only_b"),
    )


def semi_gate(scores: DataFrame, offenders: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Keep the score only for listed entities, otherwise 0 (rows are kept)."""
    listed = offenders.select(key).distinct().withColumn("_hit", F.lit(1))
    return scores.join(listed, key, "left").withColumn(
        score, F.when(F.col("_hit") == 1, F.col(score)).otherwise(F.lit(0.0))
    ).drop("_hit")
