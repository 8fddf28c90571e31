"""Sessions, fault episodes, event indexes and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import DAY, HOUR, idiv, valid_code
from .joins import merge_intervals
from .scan import running, scan, segments, sequence_number, with_neighbour
from .summaries import with_percentiles


def sessionize(df: DataFrame, keys: list[str], t: str, gap: int, width: int = DAY, name: str = "episode_id") -> DataFrame:
    """New session when the gap to the previous row is missing or ``> gap``."""
    d = segments(df, keys, [t], idiv(t, width), lambda p, c: c[t] - p[t] > gap, name, prev={"_prev": t})
    return d.withColumn("gap_us", F.col(t) - F.col("_prev")).drop("_prev")


def episodes(df: DataFrame, keys: list[str], t: str, gap: int, width: int = DAY) -> DataFrame:
    s = sessionize(df, keys, t, gap, width)
    return s.groupBy(*keys, "episode_id").agg(
        F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("observations"),
        ((F.max(t) - F.min(t)) / 1_000_000).alias("duration_seconds"),
    )


def code_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("code").agg(
        F.count("*").alias("observations"), F.count_distinct("entity").alias("entities"),
        F.count_distinct("grp").alias("groups"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


def event_index(eps: DataFrame, near: int = 2 * HOUR, clean: int = 72 * HOUR, width: int = 30 * DAY) -> DataFrame:
    """Isolation flags and clusters for episodes ``entity, grp, code, start_t, end_t`` (read twice: pass them written).

    A cluster holds the episodes of one group that begin at the same microsecond with one code.
    """
    chunk = idiv("start_t", width)
    order = ["start_t", "code", "end_t"]
    d = scan(eps, ["entity"], order, chunk, run={"previous_end": ("max", F.col("end_t"), "before")},
             lead={"next_start": "start_t"})
    before, after = F.col("start_t") - F.col("previous_end"), F.col("next_start") - F.col("start_t")
    d = d.withColumns({
        "hours_since_previous_end": before / HOUR,
        "hours_to_next_start": after / HOUR,
        "isolated": (before.isNull() | (before > near)) & (after.isNull() | (after > near)),
        "clean_pre": before.isNull() | (before > clean),
    })
    return d.withColumn("cluster_size", F.count("*").over(Window.partitionBy("grp", "code", "start_t")))


def cluster_numbers(events: DataFrame, cols: list[str], order_col: str, width: int = DAY) -> DataFrame:
    """Dense 1-based number per distinct ``cols`` in global order, without a global sort."""
    d = events.select(*cols).distinct()
    return sequence_number(d, [], [order_col, *[c for c in cols if c != order_col]], idiv(order_col, width), "cluster_no")


def horizon_balance(onsets: DataFrame, horizons: dict[str, int], lo, hi, step: int) -> DataFrame:
    """Total positive time per horizon: union of ``[onset - h, onset)`` inside the data window."""
    h = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("len")) for n, v in horizons.items()])
    d = onsets.select("entity", "t", F.explode(h).alias("h")).select(
        "entity", F.col("h.name").alias("horizon"),
        F.greatest(F.col("t") - F.col("h.len"), lo).alias("s"), F.least(F.col("t"), hi).alias("e"),
    ).where(F.col("s") < F.col("e"))
    m = merge_intervals(d, ["entity", "horizon"], "s", "e")
    return m.groupBy("horizon").agg(F.count("*").alias("islands"), (F.sum(F.col("end") - F.col("start")) / step).alias("positive_steps"))


def node_incidents(onsets: DataFrame, gap: int, width: int = DAY) -> DataFrame:
    """Events of one group within ``gap`` of each other form one incident."""
    d = segments(onsets.select("grp", "entity", "t", "event_id"), ["grp"], ["t", "entity", "event_id"], idiv("t", width),
                 lambda p, c: c["t"] - p["t"] > gap, "incident")
    return d.groupBy("grp", "incident").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("events"),
        F.count_distinct("entity").alias("entities"),
    )


def gap_table(times: DataFrame, t: str, step: int, width: int = DAY) -> DataFrame:
    """Recording gaps longer than ``step``, one row per time chunk: ``chunk, gaps, before``.

    Rows collapse map-side to the first and last time per ``step``-wide bucket (two
    times of one bucket are never a gap apart), buckets to one ordered array per
    chunk of ``width``, and chunks are compared in order. The arrays are bounded by
    ``width / step`` and the table by the number of chunks, whatever the row count.
    ``before`` counts the gaps of earlier chunks; a gap belongs to the chunk of its end.
    """
    per = max(1, width // step)
    b = times.groupBy(idiv(t, step).alias("_b")).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    c = b.groupBy(idiv("_b", per).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("a"))
    w = Window.orderBy("chunk")
    c = c.withColumn("_p", F.lag(F.element_at("a", -1)).over(w))
    c = c.withColumn("a", F.when(F.col("_p").isNotNull(), F.concat(F.array("_p"), "a")).otherwise(F.col("a")))
    # Neighbours in the ordered array; the first chunk has no predecessor.
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size("a"), F.lit(2))), lambda i: F.struct(
        F.try_element_at("a", i - 1)["hi"].alias("gap_start"), F.try_element_at("a", i)["lo"].alias("gap_end")))
    gaps = F.filter(pairs, lambda g: F.coalesce(g["gap_end"] - g["gap_start"] > step, F.lit(False)))
    c = c.select("chunk", gaps.alias("gaps"))
    n = F.size("gaps").cast("bigint")
    return c.select("chunk", "gaps", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def recording_gaps(times: DataFrame, t: str, step: int, width: int = DAY) -> DataFrame:
    """Intervals where consecutive distinct times are more than ``step`` apart."""
    g = gap_table(times, t, step, width).select(F.explode("gaps").alias("g")).select("g.*")
    return g.withColumn("missing_rows", idiv(F.col("gap_end") - F.col("gap_start"), step) - 1)


def episode_ledger(log: DataFrame, gap: int, recording_gap: int | None = None, width: int = HOUR) -> DataFrame:
    """Fault episodes with censoring evidence from a log of observed codes.

    A row is observed when its code is a whole number >= 0. Over observed rows an
    episode starts at a positive code after a zero, another code, nothing, or more
    than ``gap``. Zero closes; unobserved rows neither close nor extend. A hole in
    the global recording longer than ``recording_gap`` closes everything.
    ``uncertain_onset``: the row just before the start was unobserved or missing.

    One two-level scan: rows see the previous and next observed row inside their
    ``(entity, chunk)``; what crosses a chunk border is settled on one summary row
    per chunk and joined back. ``width`` bounds the rows of the hottest entity in one
    task: at a 15-second cadence an hour is 240 rows of it.
    """
    rg = gap if recording_gap is None else recording_gap
    per = max(1, width // rg)
    holes = gap_table(log, "t", rg, width)
    rows = log.select("entity", "t", F.coalesce(valid_code("code"), F.lit(-1)).alias("c"), idiv(idiv("t", rg), per).alias("_hc"))
    # One small row per time chunk; Spark broadcasts it when its measured size allows, else it shuffles.
    rows = rows.join(holes.withColumnRenamed("chunk", "_hc"), "_hc", "left")
    nth = F.coalesce("before", F.lit(0)) + F.size(F.filter(F.coalesce("gaps", F.array()), lambda g: g["gap_end"] <= F.col("t")))
    rows = rows.select("entity", "t", "c", nth.cast("bigint").alias("s"), idiv("t", width).alias("_chunk"))

    def starts(p, c):
        return (p["c"] != c["c"]) | (c["t"] - p["t"] > gap) | (p["s"] != c["s"])

    key = ["entity", "_chunk"]
    asc, desc = Window.partitionBy(*key).orderBy("t"), Window.partitionBy(*key).orderBy(F.desc("t"))
    rows = rows.withColumn("_cur", F.struct("t", "c", "s")).withColumn("_obs", F.when(F.col("c") >= 0, F.col("_cur")))
    rows = rows.withColumns({"_any": F.lag("c").over(asc), "_po": F.last("_obs", ignorenulls=True).over(asc.rowsBetween(Window.unboundedPreceding, -1))})
    new = F.when((F.col("c") > 0) & F.col("_po").isNotNull(), starts(F.col("_po"), F.col("_cur")).cast("bigint")).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("_loc", F.sum("_new").over(asc.rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy(*key).agg(F.min("_obs").alias("fo"), F.max("_obs").alias("lo"), F.sum("_new").alias("n"), F.max_by("c", "t").alias("la"))
    cw, cd = Window.partitionBy("entity").orderBy("_chunk"), Window.partitionBy("entity").orderBy(F.desc("_chunk"))
    edges = edges.withColumns({"_cpo": F.last("lo", ignorenulls=True).over(cw.rowsBetween(Window.unboundedPreceding, -1)), "_cany": F.lag("la").over(cw)})
    edges = edges.withColumn("_cno", F.last("fo", ignorenulls=True).over(cd.rowsBetween(Window.unboundedPreceding, -1)))
    open_ = F.when((F.col("fo.c") > 0) & (F.col("_cpo").isNull() | starts(F.col("_cpo"), F.col("fo"))), 1).otherwise(0)
    edges = edges.withColumn("_open", open_.cast("bigint"))
    edges = edges.withColumn("_base", F.sum(F.col("_open") + F.col("n")).over(cw.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    local = rows.withColumn("_no", F.last("_obs", ignorenulls=True).over(desc.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("c") > 0)
    pos = local.join(edges.select(*key, "_base", "_cany", "_cno"), key)
    pos = pos.select("entity", "t", "c", "s", (F.col("_base") + F.col("_loc")).alias("_ep"), F.coalesce("_any", "_cany").alias("_before"),
                     F.coalesce("_no", "_cno").alias("_next"))
    ep = pos.groupBy("entity", "_ep").agg(
        F.min("c").alias("code"), F.min("t").alias("onset_t"), F.max("t").alias("end_t"), F.max("s").alias("_s"),
        F.min_by("_before", "t").alias("_before"), F.max_by("_next", "t").alias("z"))
    # A recording hole also closes an episode that has no later observed row.
    total = holes.agg(F.coalesce(F.sum(F.size("gaps")), F.lit(0)).cast("bigint"))
    reason = (
        F.when(F.coalesce(F.col("z.s"), total.scalar()) > F.col("_s"), "time_gap")
        .when(F.col("z").isNull(), "end_of_file")
        .when(F.col("z.c") == 0, "observed_zero")
        .otherwise("repeat_timeout_or_code_change")
    )
    return ep.select("entity", "code", "onset_t", "end_t", (F.coalesce("_before", F.lit(-1)) < 0).alias("uncertain_onset"),
                     reason.alias("close_reason"))


def ledger_audit(ledger: DataFrame, gaps: dict[str, int], width: int = 30 * DAY) -> DataFrame:
    """Certain/uncertain counts and how often another code follows within each gap."""
    chunk = idiv("onset_t", width)
    d = with_neighbour(ledger, ["entity"], ["onset_t", "code"], chunk, {"_pc": "code", "_pt": "onset_t"})
    cross = F.col("_pc").isNotNull() & (F.col("_pc") != F.col("code"))
    return d.groupBy("code").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("uncertain_onset")).alias("uncertain"),
        *[F.count_if(cross & (F.col("onset_t") - F.col("_pt") <= g)).alias(f"cross_{n}") for n, g in gaps.items()],
    )


def rolling_feasibility(ledger: DataFrame, origins: DataFrame, length: int, minimum: int = 20) -> DataFrame:
    """Certain onsets per code inside each rolling training span: min, median, max, spans below ``minimum``.

    ``origins``: ``origin_t`` (span end). Counts come from one sweep per code, not from pairs.
    """
    from .joins import event_counts

    ends = origins.agg(F.collect_set("origin_t"))  # one entry per scheduled origin
    spans = ledger.select("code").distinct().withColumn("origin_t", F.explode(ends.scalar()))
    d = event_counts(spans, ledger.where(~F.col("uncertain_onset")), ["code"], "origin_t", "onset_t", {"n": length}, right_inclusive=False)
    return d.groupBy("code").agg(F.count("*").alias("spans"), F.min("n").alias("min_onsets"), F.percentile("n", 0.5).alias("median_onsets"),
                                 F.max("n").alias("max_onsets"), F.count_if(F.col("n") < minimum).alias("thin_spans"))


def longest_run(df: DataFrame, keys: list[str], bin_col: str, flag) -> DataFrame:
    """Longest run of consecutive bins where ``flag`` holds, per key (grid rows)."""
    w = Window.partitionBy(*keys).orderBy(bin_col)
    hit = df.where(flag).withColumn("_isl", F.col(bin_col) - F.row_number().over(w))
    return hit.groupBy(*keys, "_isl").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("max_run"))


def fault_clusters(events: DataFrame) -> DataFrame:
    """Roll-up per (group, code, start): size, longest duration, first member."""
    return events.groupBy("grp", "code", "start_t").agg(
        F.count_distinct("entity").alias("entities"), F.max("duration_seconds").alias("max_duration"),
        F.count_if(F.col("isolated")).alias("isolated_members"), F.min_by("entity", "episode_id").alias("first_entity"),
    )


def recurrence(onsets: DataFrame, width: int = HOUR) -> DataFrame:
    """Inter-arrival quantiles per code and shares within 1 h, 24 h and 7 d."""
    d = with_neighbour(onsets, ["code"], ["t", "entity"], idiv("t", width), {"_p": "t"})
    gap = (F.col("t") - F.col("_p")) / HOUR
    d = d.withColumn("gap_h", gap).where(F.col("gap_h").isNotNull())
    a = d.groupBy("code").agg(
        F.count("*").alias("gaps"), F.avg((F.col("gap_h") <= 1).cast("double")).alias("within_1h"),
        F.avg((F.col("gap_h") <= 24).cast("double")).alias("within_24h"), F.avg((F.col("gap_h") <= 168).cast("double")).alias("within_7d"))
    return with_percentiles(a, d, ["code"], "gap_h", {"q25_h": 0.25, "q50_h": 0.5, "q75_h": 0.75})
