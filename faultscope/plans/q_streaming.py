"""Streaming plans, checked against batch SQL.

The events arrive in groups of files, one micro-batch each (at least ``SLICES``, and so many
that a group has about ``GROUP_ROWS`` rows at most), ordered by time plus up to half an hour: rows are late, but within the delay of an hour, so the batch result is
due row by row. Machines with memory give out what the last watermark has passed.
"""

from pyspark.sql import Window, functions as F

from ..canonical import GROUP_SIZE
from ..functions.scalar import idiv
from ..session import scratch_path
from ..streaming import jobs as J
from .oracle import D, H
from .registry import plan


SLICES, FILES, GROUP_ROWS = 6, 2, 5_000_000


def groups(c) -> int:
    return max(SLICES, -(-c.table("events").count() // GROUP_ROWS))


def arrivals(c, path=None, first=0, last=None):
    """The events table as files in the order of arrival."""
    e = c.table("events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    late = t + F.pmod(F.col("event_id") * 7919, F.lit(1800)) * F.lit(1_000_000)
    span = e.agg(F.min(t).alias("a"), F.max(t).alias("b")).select(F.struct("a", "b")).scalar()
    n = groups(c)
    group = F.least(idiv((late - span["a"]) * n, span["b"] - span["a"] + 1), F.lit(n - 1))
    return J.arrival_files(e, path or scratch_path(c.spark, "arrivals"), group, n, FILES, first, last)


def source(c, path=None):
    """Telemetry as a stream, in the canonical columns."""
    schema = c.table("events").schema
    s = J.read_events(c.spark, path or arrivals(c), schema, "*.parquet", FILES)
    k = F.get_json_object("props", "$.k").cast("double")
    return s.select(
        F.col("user_id").alias("entity"), idiv("user_id", GROUP_SIZE).alias("grp"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.round(F.col("value") * 100).alias("value"), k.alias("temp"), "event_type", "event_id")


def fault_stream(c, path=None):
    return source(c, path).where(F.col("event_type") == "error").select("entity", "ts", "t", F.when(F.pmod("temp", F.lit(2.0)) == 0, 31).otherwise(43).cast("bigint").alias("code"))


us = F.unix_micros
WM = f"wm AS (SELECT (max(t) // 1000) * 1000 - {H} AS w FROM tel)"


@plan("stream_bins", "T1", ("tel",), f"""{WM}, b AS (SELECT entity, t // {D} * {D} AS start_t, avg(util) AS mean, stddev_pop(util) AS std, count(*) AS n FROM tel GROUP BY 1, 2)
SELECT entity, start_t, mean, std, n FROM b, wm WHERE start_t + {D} <= w""", "mean std")
def _(c):
    d = J.run_to_table(J.stream_bins(source(c), "1 day", "1 hour"), "bins")
    return d.select("entity", us("start").alias("start_t"), "mean", "std", "n")


@plan("stream_sessions", "T2", ("tel", "faults"), f"""wm AS (SELECT (max(t) // 1000) * 1000 - {H} AS w FROM faults), a AS (SELECT *, t - lag(t) OVER (PARTITION BY entity, code ORDER BY t) AS g FROM faults),
b AS (SELECT *, sum(CASE WHEN g IS NULL OR g > {D} THEN 1 ELSE 0 END) OVER (PARTITION BY entity, code ORDER BY t) AS s FROM a),
e AS (SELECT entity, code, min(t) AS start_t, max(t) AS end_t, count(*) AS observations FROM b GROUP BY entity, code, s) SELECT e.* FROM e, wm WHERE end_t + {D} <= w""")
def _(c):
    d = J.run_to_table(J.stream_episodes(fault_stream(c), "24 hours", "1 hour"), "sessions")
    return d.select("entity", "code", us("start_ts").alias("start_t"), us("end_ts").alias("end_t"), "observations")


LEDGER = f"""wm AS (SELECT (max(t) // 1000) - 3600000 AS w FROM flog), r AS (SELECT entity, t, coalesce(code, -1)::BIGINT AS c FROM flog, wm WHERE t <= w * 1000), r2 AS (SELECT *, lag(c) OVER (PARTITION BY entity ORDER BY t) AS ac FROM r),
o AS (SELECT *, lag(c) OVER w AS pc, lag(t) OVER w AS pt, lead(c) OVER w AS nc, lead(t) OVER w AS nt FROM r2 WHERE c >= 0 WINDOW w AS (PARTITION BY entity ORDER BY t)),
p AS (SELECT *, sum((pt IS NULL OR pc <> c OR t - pt > {D})::INT) OVER (PARTITION BY entity ORDER BY t) AS ep FROM o WHERE c > 0),
l AS (SELECT entity, min(c) AS code, min(t) AS onset_t, max(t) AS end_t, coalesce(arg_min(coalesce(ac, -1), t), -1) < 0 AS uncertain_onset, max(CASE WHEN nt IS NULL THEN 1 ELSE 0 END) AS is_open, arg_max(coalesce(nc, -1), t) AS nc, max(nt) AS nt FROM p GROUP BY entity, ep)
SELECT entity, code, onset_t, end_t, uncertain_onset, CASE WHEN is_open = 1 OR nt - end_t > {D} THEN 'time_gap' WHEN nc = 0 THEN 'observed_zero' ELSE 'repeat_timeout_or_code_change' END AS close_reason FROM l, wm WHERE is_open = 0 OR (end_t + {D}) // 1000 + 1 <= w"""


def ledger_stream(c, path=None):
    s = source(c, path)
    code = (F.when(F.col("event_type") == "error", F.when(F.pmod("temp", F.lit(2.0)) == 0, 31).otherwise(43)).when(F.col("event_type") == "signup", F.lit(None)).otherwise(0))
    return J.stream_ledger(s.select("entity", "ts", "t", code.cast("double").alias("code")), 24 * 3_600_000_000, "1 hour")


@plan("stream_ledger", "T3 D3", ("flog",), LEDGER)
def _(c):
    return J.run_to_table(ledger_stream(c), "ledger")


@plan("stream_resume", "T9 T12", ("flog",), LEDGER)
def _(c):
    """Half of the files, stop, the other half from the checkpoint: the same table as the whole run."""
    where, out, ckpt = (scratch_path(c.spark, x) for x in ("arrivals", "resumed", "resumed-ckpt"))
    n = groups(c)
    for first, last in ((0, n // 2 - 1), (n // 2, n - 1)):
        d = J.run_to_table(ledger_stream(c, arrivals(c, where, first, last)), "resumed", ckpt, out)
    return d


WMT = f"wt AS (SELECT (max(t) // 1000) * 1000 - {H} AS w FROM tel), "


@plan("stream_inertia", "T4", ("tel",), WMT + f"""z AS (SELECT entity, t, temp / 10 - 5 AS z, row_number() OVER (PARTITION BY entity ORDER BY t) AS r FROM (SELECT entity, t, min(temp) AS temp FROM tel, wt WHERE t <= w GROUP BY 1, 2)),
e AS (SELECT entity, t, r, z AS blended, z AS m FROM z WHERE r = 1 UNION ALL
 SELECT z.entity, z.t, z.r, CASE WHEN z.t - e.t >= {D} THEN z.z ELSE (z.z + 1.0 * e.m) / 2.0 END, CASE WHEN z.t - e.t >= {D} THEN z.z ELSE pow(2.0, -(z.t - e.t) / (6.0 * {H})) * e.m + (1 - pow(2.0, -(z.t - e.t) / (6.0 * {H}))) * z.z END
 FROM e JOIN z ON z.entity = e.entity AND z.r = e.r + 1) SELECT entity, t, blended FROM e""", "blended")
def _(c):
    s = source(c).select("entity", "ts", "t", (F.col("temp") / 10 - 5).alias("z"))
    return J.run_to_table(J.stream_inertia(s, 1.0, 6.0, "1 hour"), "inertia")


@plan("stream_alerts", "T5 T9", ("tel",), WMT + f"""z AS (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t, temp) - 1 AS n, sum((temp >= 70)::INT) OVER (PARTITION BY entity ORDER BY t, temp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM tel, wt WHERE t <= w),
c AS (SELECT entity, n, t FROM z WHERE h >= 3), a AS (SELECT entity, min(n) AS n FROM c GROUP BY 1 UNION ALL SELECT a.entity, (SELECT min(c.n) FROM c WHERE c.entity = a.entity AND c.n >= a.n + 6) FROM a WHERE EXISTS (SELECT 1 FROM c WHERE c.entity = a.entity AND c.n >= a.n + 6))
SELECT z.entity, z.t FROM a JOIN z ON z.entity = a.entity AND z.n = a.n""")
def _(c):
    s = source(c).select("entity", "ts", "t", F.col("temp").alias("score"))
    return J.run_to_table(J.stream_alerts(s, 70.0, 3, 5, 6, "1 hour"), "alerts")


@plan("stream_maturation", "T6", ("tel", "faults"), f"""m AS (SELECT least((SELECT max(t) FROM tel WHERE event_type = 'view'), (SELECT max(t) FROM faults)) - {D} - 2 * {H} AS w)
SELECT s.event_id, (count(f.t) > 0)::BIGINT AS label, count(f.t) AS onsets FROM m, tel s LEFT JOIN faults f ON f.entity = s.entity AND f.t > s.t AND f.t <= s.t + {D} WHERE s.event_type = 'view' AND s.t <= m.w GROUP BY 1""")
def _(c):
    """One label, 0 or 1, for each score whose horizon the watermark has passed."""
    path = arrivals(c)
    v = source(c, path).where(F.col("event_type") == "view").select("entity", "ts", "event_id")
    d = J.run_to_table(J.stream_matured(v, fault_stream(c, path), "24 HOURS", "1 hour"), "matured")
    last = F.least(c.telemetry.where(F.col("event_type") == "view").agg(F.max("t")).scalar(), c.faults.agg(F.max("t")).scalar())
    d = d.where(us("ts") <= last - F.lit(D + 2 * H))
    return d.groupBy("event_id").agg((F.count("onset_ts") > 0).cast("bigint").alias("label"), F.count("onset_ts").alias("onsets"))


@plan("stream_counts", "T7", ("tel", "faults"), f"""wm AS (SELECT (max(t) // 1000) * 1000 - {H} AS w FROM faults), x AS (SELECT entity, t // {D} * {D} - unnest(range(0, 7)) * {D} AS start_t FROM faults)
SELECT entity, start_t, count(*) AS n FROM x, wm WHERE start_t + 7*{D} <= w GROUP BY 1, 2""")
def _(c):
    d = J.run_to_table(J.stream_counts(fault_stream(c), "7 days", "1 day", "1 hour"), "counts")
    return d.select("entity", us("start").alias("start_t"), "n")


@plan("stream_topk", "T8", ("tel",), WMT + f"""k AS (SELECT event_id AS item, t // {D} AS day, row_number() OVER (PARTITION BY t // {D} ORDER BY temp DESC, event_id) AS rank FROM tel)
SELECT item, day, rank FROM k, wt WHERE rank <= 10 AND (day + 1) * {D} <= w""")
def _(c):
    s = source(c).select("ts", "t", F.col("temp").alias("score"), F.col("event_id").alias("item"))
    best = J.run_to_table(J.stream_topk(s, D, 10, "1 hour"), "topk")
    w = Window.partitionBy("start").orderBy(F.desc("score"), "item")  # at most salts * k rows a window
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10").select("item", idiv("start", D).alias("day"), "rank")


@plan("stream_gaps", "T10", ("tel",), WMT + f"""a AS (SELECT grp, t, lag(t) OVER (PARTITION BY grp ORDER BY t) AS p FROM (SELECT DISTINCT grp, t FROM tel, wt WHERE t <= w))
SELECT grp, p AS gap_start, t AS gap_end, (t - p) // (2*{H}) - 1 AS missing_rows, max((t - p) // (2*{H}) - 1) OVER (PARTITION BY grp ORDER BY t) AS longest FROM a WHERE t - p > 2*{H}""")
def _(c):
    s = source(c).select("grp", "ts", "t")
    return J.run_to_table(J.stream_gaps(s, 2 * 3_600_000_000, "1 hour", "grp"), "gaps")


@plan("stream_dedup", "T11", ("tel",), f"SELECT DISTINCT entity, t // {D} AS day FROM tel")
def _(c):
    s = source(c).select("entity", "ts", idiv("t", D).alias("day"))
    return J.run_to_table(J.stream_dedup(s, "2 days", ["entity", "day"]), "dedup").select("entity", "day")


@plan("sql_functions", "D6 F4 F6 F7 F9 F11", ("scores",), "SELECT entity, bin, ln(p1 / (1 - p1)) AS z, least(0.6, 1.0 / (k + 1)) * p1 + (1 - least(0.6, 1.0 / (k + 1))) * p2 AS fused FROM scores", "z fused")
def _(c):
    from ..functions.register import register_functions
    register_functions(c.spark)
    c.scores.createOrReplaceTempView("fs_scores")
    return c.spark.sql("SELECT entity, bin, fs_logit(p1) AS z, fs_fuse(p1, p2, fs_event_weight(k, 1.0D, 0.6D)) AS fused FROM fs_scores")
