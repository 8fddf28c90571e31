"""Scans, grids, windows, peers, feature sets."""

from pyspark.sql import functions as F

from ..canonical import METRICS, T0
from ..functions.scalar import DAY, HOUR
from ..operators import features as X
from ..operators import grid as G
from ..operators import windows as W
from .oracle import D, H, STEP
from .registry import plan

K = ["entity"]


def levels(c):
    return c.grid.select("entity", "grp", "slot", "bin", *[F.col(f"{m}_mean").alias(m) for m in METRICS])


LV = "lv AS (SELECT entity, grp, slot, bin, util_mean AS util, temp_mean AS temp, power_mean AS power, fb_mean AS fb FROM grid)"


def win(cols, w, gap, tag="", stats="n mean std max min last delta"):
    """Oracle columns of a lagged window."""
    fn = {"n": "count", "mean": "avg", "std": "stddev_pop", "max": "max", "min": "min"}
    out = []
    for c in cols:
        for s in stats.split():
            if s == "last":
                e = f"lag({c}, {gap}) OVER w"
            elif s == "delta":
                e = f"lag({c}, {gap}) OVER w - avg({c}) OVER (w ROWS BETWEEN {w + gap - 1} PRECEDING AND {gap} PRECEDING)"
            else:
                e = f"{fn[s]}({c}) OVER (w ROWS BETWEEN {w + gap - 1} PRECEDING AND {gap} PRECEDING)"
            out.append(f"CASE WHEN lag(bin, {w + gap - 1}) OVER w IS NOT NULL THEN {e} END AS {c}_{s}{tag}")
    return ",\n ".join(out)


WIN = "WINDOW w AS (PARTITION BY entity ORDER BY bin)"


def names(cols, stats, tag=""):
    return " ".join(f"{c}_{s}{tag}" for c in cols for s in stats.split())


@plan("bin_means", "A4 P3", ("binned",), "SELECT * FROM binned", "util_mean temp_mean power_mean fb_mean")
def _(c):
    return c.binned


@plan("bin_std", "A5", ("tel",), f"""SELECT entity, (t - {T0}) // {STEP} AS bin, stddev_pop(util) AS util_std, count(util) AS util_n FROM tel GROUP BY 1, 2""", "util_std")
def _(c):
    return G.bin_std(c.telemetry, ["entity"], "t", T0, 6 * HOUR, "util")


@plan("dense_grid", "S13", ("grid",), "SELECT * FROM grid", "util_mean temp_mean power_mean fb_mean")
def _(c):
    return c.grid


@plan("metric_assembly", "S4 U1", ("tel",), f"""b AS (SELECT entity, (t - {T0}) // {STEP} AS bin,
 avg(CASE WHEN event_type <> 'view' THEN util END) AS u, avg(CASE WHEN event_type = 'click' THEN temp END) AS te,
 count(*) FILTER (WHERE event_type <> 'view') AS ru, count(*) FILTER (WHERE event_type = 'click') AS rt FROM tel GROUP BY 1, 2)
SELECT entity, bin, u AS util, te AS temp, (u IS NULL)::BIGINT AS util_value_absent, (te IS NULL)::BIGINT AS temp_value_absent,
 (ru = 0)::BIGINT AS util_row_absent, (rt = 0)::BIGINT AS temp_row_absent FROM b WHERE ru > 0 OR rt > 0""", "util temp")
def _(c):
    t = c.telemetry.withColumn("bin", F.call_function("div", F.col("t") - T0, F.lit(6 * HOUR)))
    u = t.where(F.col("event_type") != "view").groupBy("entity", "bin").agg(F.avg("util").alias("value"))
    k = t.where(F.col("event_type") == "click").groupBy("entity", "bin").agg(F.avg("temp").alias("value"))
    return G.assemble_metrics({"util": u, "temp": k}, ["entity", "bin"])


@plan("group_means", "A6 J15", ("grid",), """SELECT grp, bin, avg(util_mean) AS util_node, avg(temp_mean) AS temp_node FROM grid GROUP BY 1, 2""",
      "util_node temp_node")
def _(c):
    return G.group_mean(c.grid, ["grp", "bin"], {"util_node": "util_mean", "temp_node": "temp_mean"})


@plan("member_vs_group", "J15 A44", ("grid",), """SELECT entity, bin, util_mean, avg(util_mean) OVER (PARTITION BY grp, bin) AS util_node,
 least(util_n, temp_n, power_n, fb_n) AS min_n FROM grid""", "util_mean util_node")
def _(c):
    d = G.with_group_mean(c.grid, ["grp", "bin"], {"util_node": "util_mean"})
    return G.min_coverage(d, ["util_n", "temp_n", "power_n", "fb_n"]).select("entity", "bin", "util_mean", "util_node", "min_n")


@plan("stride_sample", "S11 P21", ("grid",), "SELECT entity, bin, util_mean FROM grid WHERE bin % 4 = 0", "util_mean")
def _(c):
    return G.sample_every(c.grid, "bin", 4).select("entity", "bin", "util_mean")


@plan("contiguous_history", "P16", ("binned",), """SELECT entity, bin, coalesce(bin - lag(bin, 3) OVER (PARTITION BY entity ORDER BY bin) = 3, false) AS contiguous FROM binned""")
def _(c):
    return G.contiguous_history(c.binned, K, "bin", 3).select("entity", "bin", "contiguous")


@plan("grid_checks", "S14", ("grid",), """i AS (SELECT DISTINCT entity, grp, slot FROM grid),
g AS (SELECT grp, count(*) AS m, count(DISTINCT slot) AS s, min(slot) AS lo, max(slot) AS hi FROM i GROUP BY 1)
SELECT 'duplicate_key' AS rule, (SELECT count(*) FROM (SELECT entity, bin FROM grid GROUP BY 1, 2 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'off_grid', (SELECT count(*) FROM grid WHERE bin < 0 OR bin > (SELECT max(bin) - 1 FROM grid))
UNION ALL SELECT 'incomplete_group', (SELECT count(*) FROM g WHERE m <> 8 OR s <> 8 OR lo <> 0 OR hi <> 7)
UNION ALL SELECT 'entity_in_two_groups', (SELECT count(*) FROM (SELECT entity FROM i GROUP BY 1 HAVING count(*) > 1))""")
def _(c):
    return G.grid_violations(c.grid, "entity", "grp", "slot", "bin", F.lit(0), c.span["hi"] - 1, 8)


@plan("coverage_violations", "S15", ("grid",), "SELECT entity, bin, util_n FROM grid WHERE util_n > 4")
def _(c):
    return G.coverage_violations(c.grid.withColumn("expected", F.lit(4)), "util_n", "expected").select("entity", "bin", "util_n")


ST = "n mean std max min last delta"


@plan("lag_window_short", "W6 A45", ("grid",), f"{LV} SELECT entity, bin, {win(('util', 'temp'), 12, 3)} FROM lv {WIN}",
      names(("util", "temp"), ST))
def _(c):
    d = W.lag_window(levels(c), K, ["util", "temp"], 12, 3, tag="")
    return d.select("entity", "bin", *[F.col(x).cast("double").alias(x) for x in names(("util", "temp"), ST).split()])


@plan("lag_window_long", "W6", ("grid",), f"{LV} SELECT entity, bin, {win(('util', 'temp', 'power', 'fb'), 48, 3, '', 'mean std max min last delta')} FROM lv {WIN}",
      names(METRICS, "mean std max min last delta"))
def _(c):
    d = W.lag_window(levels(c), K, METRICS, 48, 3, tag="")
    return d.select("entity", "bin", *names(METRICS, "mean std max min last delta").split())


@plan("first_difference", "W8", ("grid",), f"{LV} SELECT entity, bin, util - lag(util) OVER w AS util_diff, temp - lag(temp) OVER w AS temp_diff FROM lv {WIN}", "util_diff temp_diff")
def _(c):
    return W.first_difference(levels(c), K, ["util", "temp"]).select("entity", "bin", "util_diff", "temp_diff")


def peer_sql(m, policy):
    if policy == "legacy":
        mean = f"(coalesce(sum({m}) OVER g, 0) - coalesce({m}, 0)) / 7.0::DOUBLE"
        std = f"coalesce(stddev_pop({m}) OVER g, 0)"
        top = f"coalesce((SELECT max(y.{m}) FROM lv y WHERE y.grp = lv.grp AND y.bin = lv.bin AND y.slot <> lv.slot), {m}, 0)"
    else:
        mean = f"coalesce((SELECT avg(y.{m}) FROM lv y WHERE y.grp = lv.grp AND y.bin = lv.bin AND y.slot <> lv.slot), 0)"
        std = f"coalesce((SELECT stddev_pop(y.{m}) FROM lv y WHERE y.grp = lv.grp AND y.bin = lv.bin AND y.slot <> lv.slot), 0)"
        top = f"coalesce((SELECT max(y.{m}) FROM lv y WHERE y.grp = lv.grp AND y.bin = lv.bin AND y.slot <> lv.slot), 0)"
    return (f"{mean} AS {m}_peer_mean, {top} AS {m}_peer_max, {std} AS {m}_peer_std, "
            f"(rank() OVER (PARTITION BY grp, bin ORDER BY coalesce({m}, 0) DESC))::DOUBLE AS {m}_peer_rank")


def ratio_sql(n, d):
    return f"CASE WHEN abs({d}) > 1e-4 AND {n} IS NOT NULL THEN greatest(-100.0, least(100.0, ({n}) / ({d}))) ELSE 0.0::DOUBLE END"


def peer_plan(policy):
    body = f"""{LV}, p AS (SELECT entity, bin, temp, {peer_sql('temp', policy)} FROM lv WINDOW g AS (PARTITION BY grp, bin))
SELECT entity, bin, temp_peer_mean, temp_peer_max, temp_peer_std, temp_peer_rank, coalesce(temp, 0) - temp_peer_mean AS temp_peer_diff,
 {ratio_sql('coalesce(temp, 0) - temp_peer_mean', 'temp_peer_std')} AS temp_peer_z FROM p"""
    cols = "temp_peer_mean temp_peer_max temp_peer_std temp_peer_rank temp_peer_diff temp_peer_z"

    @plan(f"peer_stats_{policy}", "J16 W15 W16 W17", ("grid",), body, cols, digits=5)
    def _(c):
        return W.peer_stats(levels(c), ["grp", "bin"], "slot", "temp", policy=policy).select("entity", "bin", *cols.split())


peer_plan("legacy")
peer_plan("null_aware")


@plan("window_slope", "W26", ("grid",), f"""{LV} SELECT entity, bin, CASE WHEN lag(bin, 14) OVER w IS NOT NULL THEN
 regr_slope(temp, bin * 6.0::DOUBLE) OVER (w ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) END AS temp_slope12 FROM lv {WIN}""", "temp_slope12")
def _(c):
    return W.slope_per_hour(levels(c), K, "temp", 12, 3, 6.0).select("entity", "bin", "temp_slope12")


@plan("window_coverage", "W28", ("grid",), f"""{LV}, z AS (SELECT entity, bin, lag(bin, 14) OVER w IS NOT NULL AS ok,
 count(temp) OVER f AS n, max(CASE WHEN temp IS NOT NULL THEN bin END) OVER f AS lv FROM lv
 WINDOW w AS (PARTITION BY entity ORDER BY bin), f AS (PARTITION BY entity ORDER BY bin ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING))
SELECT entity, bin, n::DOUBLE AS valid, 1 - n / 12.0::DOUBLE AS missing, (CASE WHEN n > 0 THEN (bin - 3 - lv) * 360 ELSE 12 * 360 END)::DOUBLE AS stale_min FROM z WHERE ok""", "missing stale_min valid")
def _(c):
    d = W.window_coverage(levels(c), K, "temp", 12, 3, 360.0)
    return d.where(F.col("temp_valid12").isNotNull()).select("entity", "bin", F.col("temp_valid12").cast("double").alias("valid"),
                                                              F.col("temp_missing12").alias("missing"), F.col("temp_stale_min12").alias("stale_min"))


MISS = names(("util", "temp"), "miss_mean miss_max") + " missing_mean observed_mean"


@plan("missing_features", "W34", ("grid",), f"""{LV}, z AS (SELECT entity, bin, lag(bin, 14) OVER (PARTITION BY entity ORDER BY bin) IS NOT NULL AS ok,
 avg((util IS NULL)::INT) OVER f AS util_miss_mean, max((util IS NULL)::INT) OVER f::DOUBLE AS util_miss_max,
 avg((CASE WHEN slot % 2 = 0 THEN temp END IS NULL)::INT) OVER f AS temp_miss_mean, max((CASE WHEN slot % 2 = 0 THEN temp END IS NULL)::INT) OVER f::DOUBLE AS temp_miss_max
 FROM lv WINDOW f AS (PARTITION BY entity ORDER BY bin ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING))
SELECT entity, bin, util_miss_mean, util_miss_max, temp_miss_mean, temp_miss_max, (util_miss_mean + temp_miss_mean) / 2 AS missing_mean,
 1 - (util_miss_mean + temp_miss_mean) / 2 AS observed_mean FROM z WHERE ok""", MISS)
def _(c):
    d = levels(c).withColumn("temp", F.when(F.col("slot") % 2 == 0, F.col("temp")))
    d = W.missing_features(d, K, ["util", "temp"], 12, 3)
    return d.where(F.col("missing_mean").isNotNull()).select("entity", "bin", *MISS.split())


@plan("observability_score", "W10", ("grid",), """z AS (SELECT entity, bin, lag(bin, 8) OVER (PARTITION BY entity ORDER BY bin) IS NOT NULL AS ok,
 sum(util_n) OVER a / (6 * 2.0::DOUBLE) AS ra, sum(temp_n) OVER b / (6 * 2.0::DOUBLE) AS rb FROM grid
 WINDOW a AS (PARTITION BY entity ORDER BY bin ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY entity ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING))
SELECT entity, bin, least(ra, rb) AS observability FROM z WHERE ok""", "observability")
def _(c):
    d = c.grid.withColumn("expected", F.lit(2))
    d = W.observability_score(d, K, "util_n", "expected", "temp_n", "expected")
    return d.where(F.col("observability").isNotNull()).select("entity", "bin", "observability")


@plan("unknown_future_share", "A33", ("grid",), """z AS (SELECT entity, bin, max((util_n = 0)::INT) OVER f AS bad, lead(bin, 3) OVER (PARTITION BY entity ORDER BY bin) IS NULL AS off
 FROM grid WINDOW f AS (PARTITION BY entity ORDER BY bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT entity, avg((bad = 1 OR off)::INT) AS unknown_share FROM z GROUP BY 1""", "unknown_share")
def _(c):
    d = W.unknown_future(c.grid, K, F.col("util_n") == 0, 4)
    return d.groupBy("entity").agg(F.avg(F.col("unknown").cast("double")).alias("unknown_share"))


SPAN = " ".join(f"temp_{s}{n}" for n in (2, 6, 12) for s in ("m", "s", "dm", "ds"))


def span_sql(n):
    f = f"(w ROWS BETWEEN {n + 2} PRECEDING AND 3 PRECEDING)"
    g = f"(w ROWS BETWEEN {n + 1} PRECEDING AND 3 PRECEDING)"
    return (f"avg(temp) OVER {f} AS temp_m{n}, sqrt(var_pop(temp) OVER {f} * count(temp) OVER {f} / {n}) AS temp_s{n}, "
            f"avg(dif) OVER {g} AS temp_dm{n}, sqrt(var_pop(dif) OVER {g} * count(dif) OVER {g} / {n - 1}) AS temp_ds{n}")


@plan("multi_span_stats", "W30", ("grid",), f"""{LV}, d AS (SELECT *, temp - lag(temp) OVER (PARTITION BY entity ORDER BY bin) AS dif FROM lv),
z AS (SELECT entity, bin, lag(bin, 14) OVER w IS NOT NULL AS ok, {span_sql(2)}, {span_sql(6)}, {span_sql(12)} FROM d {WIN})
SELECT * EXCLUDE (ok) FROM z WHERE ok""", SPAN)
def _(c):
    d = W.multi_span(levels(c), K, ["temp"], [2, 6, 12], 3)
    return d.withColumn("_ok", W.has_history(K, 12, 3)).where("_ok").select("entity", "bin", *SPAN.split())


ROB = " ".join(f"temp_r_{s}" for s in "last mean min max std range slope dmean dmax score missing".split())


@plan("robust_window", "W29", ("grid",), f"""{LV}, d AS (SELECT *, temp - lag(temp) OVER (PARTITION BY entity ORDER BY bin) AS dif FROM lv),
a AS (SELECT entity, bin, list({{'x': temp, 'd': dif}}) OVER (w ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS l, lag(bin, 8) OVER w IS NOT NULL AS ok FROM d {WIN}),
u AS (SELECT entity, bin, unnest(l).x AS x, unnest(l).d AS d, unnest(range(1, 7)) AS i FROM a WHERE ok),
m AS (SELECT entity, bin, coalesce(avg(x), 0) AS mean, coalesce(median(x), 0) AS med, 1 - count(x) / 6.0::DOUBLE AS missing FROM u GROUP BY 1, 2),
f AS (SELECT entity, bin, i, coalesce(x, mean) AS f, coalesce(d, 0) AS d, mean, med, missing FROM u JOIN m USING (entity, bin))
SELECT entity, bin, max(CASE WHEN i = 6 THEN f END) AS temp_r_last, max(mean) AS temp_r_mean, min(f) AS temp_r_min, max(f) AS temp_r_max,
 stddev_pop(f) AS temp_r_std, max(f) - min(f) AS temp_r_range, (max(CASE WHEN i = 6 THEN f END) - max(CASE WHEN i = 1 THEN f END)) / 5 AS temp_r_slope,
 avg(d) AS temp_r_dmean, max(abs(d)) AS temp_r_dmax, (max(CASE WHEN i = 6 THEN f END) - max(med)) / greatest(1.4826 * median(abs(f - med)), 1e-3) AS temp_r_score,
 max(missing) AS temp_r_missing FROM f GROUP BY 1, 2""", ROB, digits=4)
def _(c):
    return W.robust_summary(levels(c), K, "temp", 6, 3).where(F.col("temp_r_mean").isNotNull()).select("entity", "bin", *ROB.split())


@plan("window_interpolation", "W27 M4", ("grid",), f"""{LV}, o AS (SELECT a.entity, a.bin, b.bin AS wb, b.temp AS x FROM lv a JOIN lv b ON a.entity = b.entity AND b.bin BETWEEN a.bin - 14 AND a.bin - 3
 WHERE a.bin >= (SELECT min(bin) FROM lv) + 14),
n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN {{'b': wb, 'x': x}} END IGNORE NULLS) OVER (PARTITION BY entity, bin ORDER BY wb ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
 first_value(CASE WHEN x IS NOT NULL THEN {{'b': wb, 'x': x}} END IGNORE NULLS) OVER (PARTITION BY entity, bin ORDER BY wb ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM o),
f AS (SELECT entity, bin, wb, CASE WHEN x IS NOT NULL THEN x WHEN p IS NULL THEN q.x WHEN q IS NULL THEN p.x ELSE p.x + (q.x - p.x) * (wb - p.b) / (q.b - p.b) END AS f FROM n)
SELECT entity, bin, arg_max(f, wb) AS last, avg(f) AS mean, stddev_pop(f) AS std, arg_max(f, wb) - arg_min(f, wb) AS delta FROM f WHERE f IS NOT NULL GROUP BY 1, 2""",
      "last mean std delta", digits=4)
def _(c):
    d = W.interpolated_stats(levels(c), K, ["temp"], {"x": 12}, 3, 6.0).where(F.col("temp_mean_x").isNotNull())
    return d.select("entity", "bin", *[F.col(f"temp_{s}_x").alias(s) for s in ("last", "mean", "std", "delta")])


@plan("sequence_assembly", "W31 J24", ("grid",), f"""{LV}, a AS (SELECT a.entity, a.bin, b.bin AS wb, coalesce(b.util, 0) AS u, coalesce(b.temp, 0) AS te,
 row_number() OVER (PARTITION BY a.entity, a.bin ORDER BY b.bin) AS i FROM lv a JOIN lv b ON a.entity = b.entity AND b.bin BETWEEN a.bin - 14 AND a.bin - 3 AND (a.bin - 3 - b.bin) % 2 = 0
 WHERE a.bin >= (SELECT min(bin) FROM lv) + 14)
SELECT entity, bin, count(*) AS n_steps, sum(u) AS util_sum, sum(te * i) AS temp_weighted FROM a GROUP BY 1, 2""", "util_sum temp_weighted", digits=4)
def _(c):
    d = W.sequences(levels(c), K, ["util", "temp"], 12, 3, stride=2).where(F.col("steps").isNotNull())
    ws = F.aggregate(F.sequence(F.lit(1), F.size("steps")), F.lit(0.0), lambda a, i: a + F.element_at("steps", i)["temp"] * i)
    return d.select("entity", "bin", F.size(F.col("steps")).alias("n_steps"),
                    F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["util"]).alias("util_sum"), ws.alias("temp_weighted"))


SEQ = "temp_q_mean temp_q_std temp_q_min temp_q_max temp_q_change"


@plan("sequence_summary", "W32", ("grid",), f"""{LV}, z AS (SELECT entity, bin, coalesce(temp, 0) AS temp FROM lv),
s AS (SELECT entity, bin, lag(bin, 14) OVER w IS NOT NULL AS ok, avg(temp) OVER f AS temp_q_mean, stddev_pop(temp) OVER f AS temp_q_std, min(temp) OVER f AS temp_q_min,
 max(temp) OVER f AS temp_q_max, lag(temp, 3) OVER w - lag(temp, 14) OVER w AS temp_q_change FROM z
 WINDOW w AS (PARTITION BY entity ORDER BY bin), f AS (PARTITION BY entity ORDER BY bin ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING))
SELECT * EXCLUDE (ok) FROM s WHERE ok""", SEQ)
def _(c):
    return W.sequence_summary(levels(c), K, ["temp"], 12, 3).where(F.col("temp_q_mean").isNotNull()).select("entity", "bin", *SEQ.split())


B30 = [f"{m}_{s}" for m in METRICS for s in ("last", "mean", "max", "min", "std", "delta")] + [f"{m}_{s}" for m in X.CONTEXT for s in ("node_mean", "diff_node")]
NODE = ", ".join(f"avg({m}) OVER (PARTITION BY grp, bin) AS g_{m}" for m in X.CONTEXT)
B30_SQL = f"""{LV}, g AS (SELECT *, {NODE} FROM lv),
b AS (SELECT *, {win(METRICS, 12, 3, '', 'last mean max min std delta')}, lag(bin, 14) OVER w IS NOT NULL AS ok,
 {', '.join(f'lag(g_{m}, 3) OVER w AS {m}_node_mean' for m in X.CONTEXT)} FROM g {WIN}),
b30 AS (SELECT *, {', '.join(f'{m}_last - {m}_node_mean AS {m}_diff_node' for m in X.CONTEXT)} FROM b)
"""


B30Z = ", b30z AS (SELECT * REPLACE (" + ", ".join(f"coalesce({m}_last, 0) AS {m}_last, coalesce({m}_last, 0) - coalesce({m}_mean, 0) AS {m}_delta, coalesce({m}_mean, 0) AS {m}_mean" for m in METRICS) + ", " + ", ".join(
    f"coalesce({m}_node_mean, 0) AS {m}_node_mean, coalesce({m}_last, 0) - coalesce({m}_node_mean, 0) AS {m}_diff_node" for m in X.CONTEXT) + ") FROM b30 WHERE ok)"


@plan("features_basic30_frozen", "M1", ("grid",), B30_SQL + B30Z + f" SELECT entity, grp, slot, bin, {', '.join(B30)} FROM b30z", " ".join(B30))
def _(c):
    return X.basic30(c.grid, 12, zero_last=True)


@plan("features_basic30", "M1 J15 W6", ("grid",), B30_SQL + f"SELECT entity, grp, slot, bin, {', '.join(B30)} FROM b30", " ".join(B30))
def _(c):
    return X.basic30(c.grid, 12)


def clean_sql(c):
    return f"CASE WHEN isfinite({c}) THEN {c} ELSE 0.0::DOUBLE END AS {c}"


def peer45_plan(layout):
    stats = ("last", "mean", "max", "min", "std", "delta") if layout == "unified" else ("last", "mean", "std", "delta")
    cols = [f"{m}_{s}" for m in METRICS for s in stats] + [f"{m}_{s}" for m in X.CONTEXT for s in ("node_mean", "diff_node")]
    cols += X.CROSS + X.TOPOLOGY + ([] if layout == "unified" else X.RELATIVE + X.DYNAMICS)
    peers = [f"{m}_peer_{s}" for m in X.CONTEXT for s in ("mean", "max", "std", "rank")]
    zero = "" if layout == "unified" else f""", b30z AS (SELECT * REPLACE ({', '.join(f'coalesce({m}_last, 0) AS {m}_last, coalesce({m}_last, 0) - coalesce({m}_mean, 0) AS {m}_delta, coalesce({m}_mean, 0) AS {m}_mean' for m in METRICS)},
 {', '.join(f'coalesce({m}_node_mean, 0) AS {m}_node_mean, coalesce({m}_last, 0) - coalesce({m}_node_mean, 0) AS {m}_diff_node' for m in X.CONTEXT)}) FROM b30)"""
    sql = B30_SQL + zero + f""", p AS (SELECT entity, bin, util, temp, power, {', '.join(peer_sql(m, 'legacy') for m in X.CONTEXT)} FROM lv WINDOW g AS (PARTITION BY grp, bin)),
p2 AS (SELECT *, {', '.join(f"coalesce({m}, 0) - {m}_peer_mean AS {m}_peer_diff, {ratio_sql(f'(coalesce({m}, 0) - {m}_peer_mean)', f'{m}_peer_std')} AS {m}_peer_z" for m in X.CONTEXT)} FROM p),
p3 AS (SELECT entity, bin, {', '.join(f'lag({x}, 3) OVER w AS {x}' for x in peers + [f"{m}_peer_{s}" for m in X.CONTEXT for s in ("diff", "z")])} FROM p2 {WIN}),
a AS (SELECT *, {ratio_sql('temp_mean', 'util_mean')} AS thermal_efficiency, {ratio_sql('power_std', 'temp_std')} AS power_temp_ratio,
 util_delta * fb_delta AS util_fb_coupling, {ratio_sql('power_mean', 'util_mean')} AS power_per_util, abs(temp_delta - fb_delta) AS temp_fb_divergence,
 temp_max - temp_mean AS thermal_headroom, power_max - power_mean AS power_headroom, temp_delta / 12 AS temp_slope, power_delta / 12 AS power_slope,
 {ratio_sql('temp_delta', 'temp_std')} AS thermal_persistence FROM {'b30' if layout == 'unified' else 'b30z'} b30 JOIN p3 USING (entity, bin) WHERE ok)
SELECT entity, grp, slot, bin, {', '.join(clean_sql(c) for c in cols)} FROM a"""

    @plan(f"features_peer45_{layout}", "M2 F4 F14 F15 F24 W15 W16 W17", ("grid",), sql, " ".join(cols), digits=4)
    def _(c):
        return X.peer45(c.grid, 12, layout=layout, hours=12.0, colocate=True)


peer45_plan("integrated")
peer45_plan("unified")

HIST = f"""h AS (SELECT d.entity, d.bin, d.t, count(f.t) FILTER (WHERE f.t >= d.t - 600000000 - 30*{D}) AS count_30d, max(f.t) AS lt
 FROM decisions d LEFT JOIN faults f ON f.entity = d.entity AND f.t <= d.t - 600000000 GROUP BY ALL)"""
CAL = f"(t // {H}) % 24 AS hour, (t // {D} + 3) % 7 AS dow, (((t // {D} + 3) % 7) >= 5)::BIGINT AS weekend"


@plan("features_history5", "M3 W11 W12 F3", ("decisions", "faults"), HIST + f"""SELECT entity, bin, t, count_30d, coalesce(least((t - 600000000 - lt) / {D}.0::DOUBLE, 90.0), 90.0) AS days_since, {CAL} FROM h""", "days_since")
def _(c):
    return X.history5(c.decisions.select("entity", "bin", "t"), c.faults, until=c.bounds[1])


@plan("features_hazard11", "M4 W11 W12 W13 W14", ("decisions", "faults"), f"""e AS (SELECT entity, t, lag(t) OVER (PARTITION BY entity ORDER BY t) AS pt FROM faults),
h AS (SELECT d.entity, d.bin, d.t, d.t - 600000000 AS cut, {', '.join(f"count(e.t) FILTER (WHERE e.t >= d.t - 600000000 - {n}) AS c_{k}" for k, n in (("1h", H), ("6h", 6 * H), ("24h", D), ("7d", 7 * D), ("30d", 30 * D)))},
 max(e.t) AS lt, arg_max(e.pt, e.t) AS pt FROM decisions d LEFT JOIN e ON e.entity = d.entity AND e.t <= d.t - 600000000 GROUP BY ALL),
x AS (SELECT *, greatest(0.0, least(30.0, (cut - {T0}) / {D}.0::DOUBLE)) AS exposure_days FROM h)
SELECT entity, bin, t, c_1h, c_6h, c_24h, c_7d, c_30d, coalesce(least((cut - lt) / {D}.0::DOUBLE, 90.0), 90.0) AS days_since, (lt IS NOT NULL)::BIGINT AS has_past,
 coalesce(least((lt - pt) / {D}.0::DOUBLE, 90.0), 90.0) AS last_gap_days, c_1h / greatest(c_24h, 1)::DOUBLE AS share_1h, exposure_days, c_30d / greatest(exposure_days, 1.0) AS rate_30d FROM x""",
      "days_since last_gap_days share_1h exposure_days rate_30d")
def _(c):
    return X.hazard11(c.decisions.select("entity", "bin", "t"), c.faults, T0, until=c.bounds[1])


DS = "last mean std delta slope valid missing stale min max obs"
SPANS = {"a": 4, "b": 12, "c": 40}


def dense_sql(t, w):
    f = f"(w ROWS BETWEEN {w + 2} PRECEDING AND 3 PRECEDING)"
    out = []
    for m in METRICS:
        out.append(f"""CASE WHEN count({m}) OVER {f} >= 2 THEN regr_slope({m}, bin * 6.0::DOUBLE) OVER {f} END AS {m}_slope_{t},
 count({m}) OVER {f} AS {m}_valid_{t}, 1 - count({m}) OVER {f} / {w}.0::DOUBLE AS {m}_missing_{t},
 coalesce((bin - 3 - max(CASE WHEN {m} IS NOT NULL THEN bin END) OVER {f}) * 360.0::DOUBLE, {w} * 360.0::DOUBLE) AS {m}_stale_{t},
 min({m}) OVER {f} AS {m}_min_{t}, max({m}) OVER {f} AS {m}_max_{t}, avg({m}_obs) OVER {f} AS {m}_obs_{t}""")
    return ", ".join(out)


def filled_sql(t, w):
    """Last, mean, std and delta of the series interpolated inside the window, from the window's rows themselves."""
    over, pt = "OVER (PARTITION BY entity, bin ORDER BY wb ROWS BETWEEN {})", "CASE WHEN {m} IS NOT NULL THEN {{'b': wb, 'x': {m}}} END IGNORE NULLS"
    return f"""o{t} AS (SELECT a.entity, a.bin, b.bin AS wb, {', '.join(f'b.{m}' for m in METRICS)} FROM lv a JOIN lv b ON a.entity = b.entity AND b.bin BETWEEN a.bin - {w + 2} AND a.bin - 3
 WHERE a.bin >= (SELECT min(bin) FROM lv) + 42),
n{t} AS (SELECT *, {', '.join(f"last_value({pt.format(m=m)}) {over.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS {m}_p, first_value({pt.format(m=m)}) {over.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS {m}_q" for m in METRICS)} FROM o{t}),
f{t} AS (SELECT entity, bin, wb, {', '.join(f'CASE WHEN {m} IS NOT NULL THEN {m} WHEN {m}_p IS NULL THEN {m}_q.x WHEN {m}_q IS NULL THEN {m}_p.x ELSE {m}_p.x + ({m}_q.x - {m}_p.x) * (wb - {m}_p.b) / ({m}_q.b - {m}_p.b) END AS {m}' for m in METRICS)} FROM n{t}),
i{t} AS (SELECT entity, bin, {', '.join(f'arg_max({m}, wb) AS {m}_last_{t}, avg({m}) AS {m}_mean_{t}, stddev_pop({m}) AS {m}_std_{t}, arg_max({m}, wb) - arg_min({m}, wb) AS {m}_delta_{t}' for m in METRICS)} FROM f{t} GROUP BY 1, 2)"""


DN = [f"{m}_{s}_{t}" for t in SPANS for m in METRICS for s in DS.split()]


@plan("features_dense132", "M4 W26 W27 W28", ("grid",), f"""lv AS (SELECT entity, grp, slot, bin, {', '.join(f'{m}_mean AS {m}, {m}_n AS {m}_obs' for m in METRICS)} FROM grid),
z AS (SELECT entity, bin, lag(bin, 42) OVER w IS NOT NULL AS ok, {', '.join(dense_sql(t, w) for t, w in SPANS.items())} FROM lv {WIN}),
{', '.join(filled_sql(t, w) for t, w in SPANS.items())}
SELECT * EXCLUDE (ok) FROM z JOIN ia USING (entity, bin) JOIN ib USING (entity, bin) JOIN ic USING (entity, bin) WHERE ok""", " ".join(DN))
def _(c):
    d = X.dense_features(c.grid, SPANS, 3, 6.0)
    return d.where(F.col("util_missing_c").isNotNull()).select("entity", "bin", *DN)


CTXC = [f"{c}_{s}_c" for c in (*METRICS, *[f"{m}_diff" for m in METRICS]) for s in ("mean", "std", "last", "min", "max")] + ["jobs_mean_x", "jobs_last_x"]


@plan("features_context", "M5 J2 W32", ("grid",), f"""{LV}, d AS (SELECT lv.*, {', '.join(f'{m} - lag({m}) OVER w AS {m}_diff' for m in METRICS)}, coalesce(g.util_n, 0)::DOUBLE AS jobs
 FROM lv JOIN (SELECT entity, bin, util_n FROM grid) g USING (entity, bin) {WIN})
SELECT entity, grp, slot, bin, {win((*METRICS, *[f'{m}_diff' for m in METRICS]), 12, 3, '_c', 'mean std last min max')},
 CASE WHEN lag(bin, 14) OVER w IS NOT NULL THEN avg(jobs) OVER (w ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) END AS jobs_mean_x,
 CASE WHEN lag(bin, 14) OVER w IS NOT NULL THEN lag(jobs, 3) OVER w END AS jobs_last_x FROM d {WIN}""", " ".join(CTXC))
def _(c):
    ctx = c.binned.select("entity", "bin", F.col("util_n").cast("double").alias("jobs"))
    return X.context_features(c.grid, ctx, ["jobs"], 12, 3)


T14 = [f"{m}_{s}" for m in X.CONTEXT for s in ("last", "mean", "delta", "node_mean")]


@plan("features_tape14", "M6", ("grid", "decisions", "faults"), B30_SQL + f""", {HIST}
SELECT entity, grp, slot, bin, t, {', '.join(T14)}, count_30d, coalesce(least((t - 600000000 - lt) / {D}.0::DOUBLE, 95.0), 95.0) AS days_since FROM b30 JOIN h USING (entity, bin)""", " ".join(T14) + " days_since")
def _(c):
    return X.tape14(c.grid, c.decisions, c.faults, 12, until=c.bounds[1])
