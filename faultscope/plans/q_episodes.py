"""Episodes, gaps, ledgers."""

from pyspark.sql import functions as F

from ..canonical import T0
from ..functions.scalar import DAY, HOUR
from ..operators import episodes as E
from ..operators.joins import merge_intervals
from ..session import materialize
from .oracle import D, H
from .registry import plan

EPS = f"""s0 AS (SELECT *, t - lag(t) OVER (PARTITION BY entity, code ORDER BY t) AS gap FROM faults),
s1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 24*{H} THEN 1 ELSE 0 END) OVER (PARTITION BY entity, code ORDER BY t)::BIGINT AS episode_id FROM s0),
eps AS (SELECT entity, grp, code, episode_id, min(t) AS start_t, max(t) AS end_t, count(*) AS observations,
  (max(t) - min(t)) / 1000000.0::DOUBLE AS duration_seconds FROM s1 GROUP BY ALL)
"""
EIDX = EPS + f""", ix AS (SELECT *, max(end_t) OVER (PARTITION BY entity ORDER BY start_t, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
  lead(start_t) OVER (PARTITION BY entity ORDER BY start_t, code) AS ns FROM eps),
eidx AS (SELECT *, (start_t - pe) / {H}.0::DOUBLE AS hours_since_previous_end, (ns - start_t) / {H}.0::DOUBLE AS hours_to_next_start,
  ((pe IS NULL OR start_t - pe > 6*{H}) AND (ns IS NULL OR ns - start_t > 6*{H})) AS isolated,
  (pe IS NULL OR start_t - pe > 72*{H}) AS clean_pre FROM ix)
"""


def eps(c):
    return E.episodes(c.faults, ["entity", "grp", "code"], "t", 24 * HOUR)


def eidx(c):
    return E.event_index(materialize(eps(c), "episodes"), near=6 * HOUR)


@plan("episodes_by_code", "S2 W1 W4 A7 A8", ("faults",), EPS + """
SELECT code, count(*) AS episodes, count(DISTINCT entity) AS entities, sum(observations)::BIGINT AS observations,
  min(start_t) AS first_t, max(end_t) AS last_t, avg(duration_seconds) AS mean_duration FROM eps GROUP BY 1""", "mean_duration")
def _(c):
    return eps(c).groupBy("code").agg(
        F.count("*").alias("episodes"), F.count_distinct("entity").alias("entities"),
        F.sum("observations").alias("observations"), F.min("start_t").alias("first_t"), F.max("end_t").alias("last_t"),
        F.avg("duration_seconds").alias("mean_duration"))


@plan("episode_sessions", "W1 W4 A8", ("faults",), EPS + "SELECT * FROM eps", "duration_seconds")
def _(c):
    return eps(c)


@plan("fault_code_summary", "A7 P24", ("faults",), """SELECT code, count(*) AS observations, count(DISTINCT entity) AS entities,
 count(DISTINCT grp) AS groups, min(t) AS first_t, max(t) AS last_t FROM faults GROUP BY 1""")
def _(c):
    return E.code_summary(c.faults)


@plan("event_index", "W2 W3 P9 W5", ("faults",), EIDX + """SELECT entity, grp, code, start_t, coalesce(pe, -1) AS previous_end,
 coalesce(ns, -1) AS next_start, hours_since_previous_end, hours_to_next_start, isolated, clean_pre,
 count(*) OVER (PARTITION BY grp, code, start_t) AS cluster_size FROM eidx""", "hours_since_previous_end hours_to_next_start")
def _(c):
    return eidx(c).select("entity", "grp", "code", "start_t", F.coalesce("previous_end", F.lit(-1)).alias("previous_end"),
                          F.coalesce("next_start", F.lit(-1)).alias("next_start"), "hours_since_previous_end",
                          "hours_to_next_start", "isolated", "clean_pre", "cluster_size")


@plan("cluster_numbers", "W5 F22", ("faults",), f"""g AS (SELECT DISTINCT grp, code, (t - {T0}) // {D} AS day FROM faults)
SELECT grp, code, day, row_number() OVER (ORDER BY day, grp, code) AS cluster_no,
 'cluster_' || lpad(row_number() OVER (ORDER BY day, grp, code)::VARCHAR, 5, '0') AS cluster_label FROM g""")
def _(c):
    from ..functions.scalar import bin_index, cluster_label
    d = c.faults.select("grp", "code", bin_index("t", T0, DAY).alias("day"))
    n = E.cluster_numbers(d, ["grp", "code", "day"], "day", width=1)
    return n.withColumn("cluster_label", cluster_label("cluster_no"))


@plan("interval_union", "A12", ("faults",), f"""iv AS (SELECT DISTINCT entity, t - 12*{H} AS s, t + 12*{H} AS e FROM faults),
a AS (SELECT *, max(e) OVER (PARTITION BY entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv),
b AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY s, e)::BIGINT AS island FROM a)
SELECT entity, island, min(s) AS start, max(e) AS "end", count(*) AS members FROM b GROUP BY 1, 2""")
def _(c):
    iv = c.faults.select("entity", (F.col("t") - 12 * HOUR).alias("s"), (F.col("t") + 12 * HOUR).alias("e"))
    return merge_intervals(iv, ["entity"], "s", "e", width=3 * DAY)


@plan("horizon_balance", "A13 J20", ("faults", "tel"), f"""w AS (SELECT min(t) AS lo, max(t) AS hi FROM tel),
h AS (SELECT * FROM (VALUES ('12h', 12*{H}), ('24h', 24*{H}), ('72h', 72*{H})) v(horizon, len)),
iv AS (SELECT DISTINCT entity, horizon, greatest(t - len, lo) AS s, least(t, hi) AS e FROM faults, h, w WHERE greatest(t - len, lo) < least(t, hi)),
a AS (SELECT *, max(e) OVER (PARTITION BY entity, horizon ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv),
b AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY entity, horizon ORDER BY s, e) AS island FROM a),
m AS (SELECT entity, horizon, island, min(s) AS s, max(e) AS e FROM b GROUP BY ALL)
SELECT horizon, count(*) AS islands, sum(e - s)::BIGINT / {H}.0::DOUBLE AS positive_steps FROM m GROUP BY 1""", "positive_steps")
def _(c):
    w = c.telemetry.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return E.horizon_balance(c.faults, {"12h": 12 * HOUR, "24h": 24 * HOUR, "72h": 72 * HOUR},
                             w.select("lo").scalar(), w.select("hi").scalar(), HOUR)


@plan("node_incidents", "A37", ("faults",), f"""a AS (SELECT *, lag(t) OVER (PARTITION BY grp ORDER BY t, entity, event_id) AS p FROM faults),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {H} THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY t, entity, event_id)::BIGINT AS incident FROM a)
SELECT grp, incident, min(t) AS first_t, max(t) AS last_t, count(*) AS events, count(DISTINCT entity) AS entities FROM b GROUP BY 1, 2""")
def _(c):
    return E.node_incidents(c.faults, HOUR)


@plan("recording_gaps", "S10", ("tel",), f"""a AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM tel))
SELECT p AS gap_start, t AS gap_end, (t - p) // 300000000 - 1 AS missing_rows FROM a WHERE t - p > 300000000""")
def _(c):
    return E.recording_gaps(c.telemetry, "t", 300_000_000)


LEDGER = f"""hl AS (SELECT t FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM flog)) WHERE t - p > 1200000000),
r AS (SELECT entity, t, coalesce(code, -1)::BIGINT AS c, sum(CASE WHEN t IN (SELECT t FROM hl) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS h FROM flog),
r2 AS (SELECT *, lag(c) OVER (PARTITION BY entity ORDER BY t) AS ac FROM r),
o AS (SELECT *, lag(c) OVER w AS pc, lag(t) OVER w AS pt, lag(h) OVER w AS ph, lead(c) OVER w AS nc, lead(t) OVER w AS nt, lead(h) OVER w AS nh
  FROM r2 WHERE c >= 0 WINDOW w AS (PARTITION BY entity ORDER BY t)),
p AS (SELECT *, (pt IS NULL OR pc <> c OR t - pt > 24*{H} OR ph <> h)::INT AS st FROM o WHERE c > 0),
p2 AS (SELECT *, sum(st) OVER (PARTITION BY entity ORDER BY t) AS ep FROM p),
ledger AS (SELECT entity, min(c) AS code, min(t) AS onset_t, max(t) AS end_t, max((st = 1 AND coalesce(ac, -1) < 0)::INT) = 1 AS uncertain_onset,
  CASE WHEN coalesce(arg_max(nh, t) FILTER (WHERE true), (SELECT count(*) FROM hl)) > max(h) THEN 'time_gap'
   WHEN max(t) = max(lt) THEN 'end_of_file' WHEN arg_max(nc, t) = 0 THEN 'observed_zero' ELSE 'repeat_timeout_or_code_change' END AS close_reason
  FROM (SELECT p2.*, max(t) OVER (PARTITION BY entity) AS mt, (SELECT max(x.t) FROM o x WHERE x.entity = p2.entity) AS lt FROM p2) GROUP BY entity, ep)
"""


def ledger(c):
    return E.episode_ledger(c.log, 24 * HOUR, recording_gap=1_200_000_000)


@plan("episode_ledger", "L1 P4", ("flog",), LEDGER + "SELECT * FROM ledger")
def _(c):
    return ledger(c)


@plan("ledger_audit", "A36", ("flog",), LEDGER + f""", a AS (SELECT *, lag(code) OVER w AS pc, lag(onset_t) OVER w AS pt FROM ledger WINDOW w AS (PARTITION BY entity ORDER BY onset_t, code))
SELECT code, count(*) AS episodes, count(*) FILTER (WHERE uncertain_onset) AS uncertain,
 count(*) FILTER (WHERE pc <> code AND onset_t - pt <= {H}) AS cross_1h, count(*) FILTER (WHERE pc <> code AND onset_t - pt <= {D}) AS cross_1d
 FROM a GROUP BY 1""")
def _(c):
    return E.ledger_audit(ledger(c), {"1h": HOUR, "1d": DAY})


@plan("fault_clusters", "A27", ("faults",), EIDX + """SELECT grp, code, start_t, count(DISTINCT entity) AS entities, max(duration_seconds) AS max_duration,
 count(*) FILTER (WHERE isolated) AS isolated_members, arg_min(entity, episode_id) AS first_entity FROM eidx GROUP BY 1, 2, 3""", "max_duration")
def _(c):
    return E.fault_clusters(eidx(c))


@plan("fault_recurrence", "A28", ("faults",), f"""a AS (SELECT code, (t - lag(t) OVER (PARTITION BY code ORDER BY t, entity)) / {H}.0::DOUBLE AS g FROM faults)
SELECT code, count(*) AS gaps, quantile_cont(g, 0.25) AS q25_h, quantile_cont(g, 0.5) AS q50_h, quantile_cont(g, 0.75) AS q75_h,
 avg((g <= 1)::INT) AS within_1h, avg((g <= 24)::INT) AS within_24h, avg((g <= 168)::INT) AS within_7d FROM a WHERE g IS NOT NULL GROUP BY 1""",
      "q25_h q50_h q75_h within_1h within_24h within_7d")
def _(c):
    return E.recurrence(c.faults)


@plan("fault_cluster_sizes", "A28 A10", ("faults",), f"""a AS (SELECT grp, code, (t - {T0}) // {D} AS day, count(DISTINCT entity) AS size FROM faults GROUP BY 1, 2, 3),
b AS (SELECT code, size, count(*) AS clusters FROM a GROUP BY 1, 2)
SELECT code, size, clusters, clusters / sum(clusters) OVER (PARTITION BY code)::DOUBLE AS share FROM b""", "share")
def _(c):
    from ..functions.scalar import bin_index
    a = c.faults.groupBy("grp", "code", bin_index("t", T0, DAY).alias("day")).agg(F.count_distinct("entity").alias("size"))
    b = a.groupBy("code", "size").agg(F.count("*").alias("clusters"))
    total = b.groupBy("code").agg(F.sum("clusters").alias("total"))
    return b.join(total, "code").select("code", "size", "clusters", (F.col("clusters") / F.col("total")).alias("share"))


@plan("longest_missing_run", "W9", ("grid",), """a AS (SELECT entity, bin - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isl FROM grid WHERE util_n = 0)
SELECT entity, max(n) AS max_run FROM (SELECT entity, isl, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1""")
def _(c):
    return E.longest_run(c.grid, ["entity"], "bin", F.col("util_n") == 0)


@plan("rolling_feasibility", "A36 P20", ("flog",), LEDGER + f""", og AS (SELECT unnest(range({T0} + 10*{D}, {T0} + 30*{D}, {D})) AS ot), cd AS (SELECT DISTINCT code FROM ledger),
nn AS (SELECT cd.code, og.ot, count(l.onset_t) AS n FROM og CROSS JOIN cd LEFT JOIN ledger l ON l.code = cd.code AND NOT l.uncertain_onset AND l.onset_t >= og.ot - 7*{D} AND l.onset_t < og.ot GROUP BY 1, 2)
SELECT code, count(*) AS spans, min(n) AS min_onsets, median(n) AS median_onsets, max(n) AS max_onsets, count(*) FILTER (WHERE n < 120) AS thin_spans FROM nn GROUP BY 1""", "median_onsets")
def _(c):
    from ..session import materialize
    led = materialize(ledger(c), "ledger")
    o = c.telemetry.agg(F.max("t").alias("hi")).select(F.explode(F.sequence(F.lit(T0 + 10 * DAY), F.lit(T0 + 29 * DAY), F.lit(DAY))).alias("origin_t"))
    return E.rolling_feasibility(led, o, 7 * DAY, 120)


@plan("daily_clusters", "A28", ("faults",), f"""SELECT code, (t - {T0}) // {D} AS day, count(DISTINCT grp) AS clusters, count(*) AS events FROM faults GROUP BY 1, 2""")
def _(c):
    from ..functions.scalar import bin_index
    return c.faults.groupBy("code", bin_index("t", T0, DAY).alias("day")).agg(F.count_distinct("grp").alias("clusters"), F.count("*").alias("events"))
