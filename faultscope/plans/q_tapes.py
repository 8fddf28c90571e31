"""Tapes, audits, sources and sinks."""

from pyspark.sql import functions as F, types as T

from ..canonical import T0
from ..functions.scalar import DAY, HOUR, mix_hash_sql, pareto_weight, value_text_sql
from ..operators import audits as A
from ..operators import grid as G
from ..operators import ranking as R
from ..operators import tapes as Tp
from ..operators.labels import positive_intervals
from ..session import materialize, scratch_path
from ..sources import readers, writers
from .oracle import D, H
from .q_episodes import EIDX, eidx
from .q_matching import RUN, runs
from .registry import plan

EVN = f"""ev AS (SELECT event_id, entity, t AS start_t FROM faults),
nb AS (SELECT entity, t, code, lag(code) OVER w AS pc, lag(t) OVER w AS pt, lead(code) OVER w AS nc, lead(t) OVER w AS nt FROM flog WINDOW w AS (PARTITION BY entity ORDER BY t)),
nr AS (SELECT e.event_id, l.t, l.code, count(l.code) OVER (PARTITION BY e.event_id ORDER BY l.t) AS g FROM ev e JOIN flog l ON l.entity = e.entity AND l.t >= e.start_t - 48*{H} AND l.t < e.start_t),
mr AS (SELECT event_id, max(n) AS missing_run FROM (SELECT event_id, g, count(*) AS n FROM nr WHERE code IS NULL GROUP BY 1, 2) GROUP BY 1),
ag AS (SELECT event_id, max(t) FILTER (WHERE code IS NOT NULL) AS lo, max(t) FILTER (WHERE code = 0) AS lz, count(code) / count(*)::DOUBLE AS vf, count(*) AS n FROM nr GROUP BY 1),
evd AS (SELECT e.event_id, e.entity, e.start_t, (pt IS NULL OR pc IS NULL OR e.start_t - pt > 24*{H}) AS left_censored, (nt IS NULL OR nc IS NULL OR nt - e.start_t > 24*{H}) AS right_censored,
 lo AS last_observed_t, lz AS last_zero_t, coalesce(vf, 0.0)::DOUBLE AS valid_fraction, coalesce(n, 0) AS rows, coalesce(missing_run, 0) AS missing_run FROM ev e JOIN nb ON nb.entity = e.entity AND nb.t = e.start_t
 LEFT JOIN ag USING (event_id) LEFT JOIN mr USING (event_id))
"""


def evidence(c):
    ev = c.faults.select("event_id", "entity", F.col("t").alias("start_t"))
    return ev, Tp.event_neighbourhood(c.log, ev, 48 * HOUR, 24 * HOUR)


@plan("event_neighbourhood", "W33", ("faults", "flog"), EVN + "SELECT event_id, entity, start_t, left_censored, right_censored, coalesce(last_observed_t, -1) AS last_observed_t, coalesce(last_zero_t, -1) AS last_zero_t, valid_fraction, rows, missing_run FROM evd", "valid_fraction")
def _(c):
    d = evidence(c)[1]
    return d.withColumn("last_observed_t", F.coalesce("last_observed_t", F.lit(-1))).withColumn("last_zero_t", F.coalesce("last_zero_t", F.lit(-1)))


V2 = EVN + f""", v2 AS (SELECT *, CASE WHEN left_censored AND last_zero_t IS NOT NULL THEN last_zero_t + 15000000 ELSE start_t END AS time_early,
 CASE WHEN valid_fraction >= 0.99 AND missing_run <= 4 THEN 'high' WHEN valid_fraction >= 0.6 THEN 'moderate' ELSE 'low' END AS status FROM evd)
"""


def v2(c):
    ev, d = evidence(c)
    return Tp.fault_tape_v2(ev, materialize(d, "evidence"), 15_000_000, moderate=0.6)


@plan("fault_tape_v2", "P12 P13", ("faults", "flog"), V2 + """SELECT event_id, start_t AS time_raw, time_early, greatest(0.0, (start_t - time_early) / 1000000.0::DOUBLE) AS uncertainty_s, status,
 CASE WHEN right_censored THEN 'right_censored' ELSE 'observed_transition' END AS duration_status FROM v2""", "uncertainty_s")
def _(c):
    return v2(c).select("event_id", "time_raw", "time_early", "uncertainty_s", "status", "duration_status")


@plan("label_readiness", "A34 P14", ("faults", "flog", "tel"), V2 + f""", h AS (SELECT * FROM (VALUES ('24h', 24*{H}), ('72h', 72*{H})) v(horizon, len))
SELECT horizon, code, count(*) AS intervals, avg(left_censored::INT) AS left_censored_share, avg((last_zero_t IS NOT NULL)::INT) AS early_bound_share, avg((status = 'high')::INT) AS high_share
 FROM v2 JOIN (SELECT event_id, code FROM faults) USING (event_id), h GROUP BY 1, 2""", "left_censored_share early_bound_share high_share")
def _(c):
    lo = c.telemetry.agg(F.min("t")).scalar()
    iv = positive_intervals(c.faults, lo, {"24h": 24 * HOUR, "72h": 72 * HOUR}, {"raw": "t"})
    iv = iv.join(c.faults.select("event_id", "code"), "event_id")
    return Tp.label_readiness(iv, v2(c), ["horizon", "code"])


@plan("fault_tape", "P10 F22 J2", ("faults", "tel"), EIDX + ", ex AS (SELECT *, count(*) OVER (PARTITION BY grp, code, start_t) AS cs FROM eidx), " + RUN.replace("ev AS (SELECT event_id, entity, grp, code, t AS start_t, t AS end_t FROM faults)", "ev AS (SELECT event_id, entity, grp, code, t AS start_t, t AS end_t FROM faults)") + f"""
SELECT f.event_id, 'xid' || x.code || '_' || x.entity || '_e' || x.episode_id AS fault_id, x.start_t AS time_raw, CASE WHEN run >= 1 THEN x.start_t - run::BIGINT * {H} ELSE x.start_t END AS time_mixed,
 CASE WHEN run >= 1 THEN 'terminal_low_supported' WHEN run IS NOT NULL THEN 'audited_no_terminal_low' ELSE 'not_audited' END AS evidence, CASE WHEN cs > 1 THEN 'multi_entity_same_group_time' ELSE 'single_entity' END AS scope,
 'unclassified' AS interrupt FROM ex x JOIN faults f ON f.entity = x.entity AND f.t = x.start_t LEFT JOIN run r ON r.event_id = f.event_id AND r.metric = 'temp'""")
def _(c):
    e = eidx(c).join(c.faults.select("event_id", "entity", F.col("t").alias("start_t")), ["entity", "start_t"])
    e = e.withColumn("class", F.lit(None).cast("string"))
    r = runs(c).where(F.col("metric") == "temp").select("event_id", "run")
    return Tp.fault_tape(e, r, HOUR, 1.0).select("event_id", "fault_id", "time_raw", "time_mixed", "evidence", "scope", "interrupt")


@plan("observability_summary", "A32 W9", ("grid",), """a AS (SELECT entity, util_n < 1 AS z, bin - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isl FROM grid WHERE util_n < 2),
i1 AS (SELECT entity, bin, bin - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isl FROM grid WHERE util_n < 2), m1 AS (SELECT entity, max(n) AS m FROM (SELECT entity, isl, count(*) AS n FROM i1 GROUP BY 1, 2) GROUP BY 1),
i2 AS (SELECT entity, bin, bin - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isl FROM grid WHERE util_n = 0), m2 AS (SELECT entity, max(n) AS m FROM (SELECT entity, isl, count(*) AS n FROM i2 GROUP BY 1, 2) GROUP BY 1)
SELECT g.entity, 1 - sum(util_n) / (count(*) * 2.0::DOUBLE) AS missing_rate, avg((util_n < 2)::INT) AS incomplete_share, median(util_n / 2.0::DOUBLE) AS median_coverage,
 coalesce(any_value(m1.m), 0) * 360.0::DOUBLE AS longest_incomplete_min, coalesce(any_value(m2.m), 0) * 360.0::DOUBLE AS longest_empty_min FROM grid g LEFT JOIN m1 ON m1.entity = g.entity LEFT JOIN m2 ON m2.entity = g.entity GROUP BY 1""",
      "missing_rate incomplete_share median_coverage longest_incomplete_min longest_empty_min")
def _(c):
    return Tp.observability_summary(c.grid.withColumn("expected", F.lit(2)), ["entity"], "util_n", "expected", 360.0)


@plan("time_axis_audit", "S9", ("tel",), """a AS (SELECT t, t - lag(t) OVER (ORDER BY event_id) AS g FROM tel)
SELECT count(*) AS rows, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (WHERE g = 0) AS duplicates, count(*) FILTER (WHERE g < 0) AS out_of_order, count(*) FILTER (WHERE g <> 300000000) AS irregular,
 max(g) AS max_gap, (max(t) - min(t)) // 300000000 + 1 AS expected_rows FROM a""")
def _(c):
    return A.time_axis_audit(c.telemetry, "event_id", "t", 300_000_000)


@plan("entity_diff", "S12 U3", ("tel",), """r AS (SELECT DISTINCT entity FROM tel), a AS (SELECT DISTINCT entity + 5 AS entity FROM tel WHERE entity % 3 <> 0)
SELECT 'shifted' AS source, 'missing' AS difference, entity FROM r WHERE entity NOT IN (SELECT entity FROM a) UNION ALL SELECT 'shifted', 'extra', entity FROM a WHERE entity NOT IN (SELECT entity FROM r)""")
def _(c):
    ids = c.telemetry.select("entity")
    return A.entity_diff({"shifted": ids.where(F.col("entity") % 3 != 0).select((F.col("entity") + 5).alias("entity"))}, ids, "entity")


@plan("key_fingerprint", "S18", ("tel",), f"""k AS (SELECT entity, t, {mix_hash_sql(7, 'entity', 't')} AS h FROM tel)
SELECT count(*) AS rows, bit_xor(h)::BIGINT AS xor_hash, sum(h)::BIGINT AS sum_hash, min(entity) AS min_entity, max(entity) AS max_entity, min(t) AS min_t, max(t) AS max_t FROM k""")
def _(c):
    return A.key_fingerprint(c.telemetry, ["entity", "t"])


CONTENT = {"entity": "bigint", "t": "bigint", "util": "double", "sixth": "double", "event_type": "string", "event_id": "bigint"}


@plan("content_fingerprint", "S18", ("tel",), f"""x AS (SELECT entity, t, nullif(util, 50.0) AS util, temp / 6.0 AS sixth, event_type, event_id FROM tel),
h AS (SELECT md5({" || ',' || ".join(value_text_sql(k, v) for k, v in CONTENT.items())}) AS h FROM x)
SELECT count(*) AS rows, coalesce(sum(('0x' || substr(h, 1, 15))::BIGINT), 0)::VARCHAR AS first_sum, coalesce(sum(('0x' || substr(h, 16, 15))::BIGINT), 0)::VARCHAR AS second_sum FROM h""")
def _(c):
    x = c.telemetry.withColumns({"sixth": F.col("temp") / 6.0, "util": F.nullif("util", F.lit(50.0))})
    return A.fingerprint(x, list(CONTENT))


RT = f"""rt AS (SELECT t AS decision_t, entity, CASE WHEN (entity * 31 + bin) % 97 = 0 THEN NULL ELSE p1 END AS risk_score, CASE WHEN (entity + bin) % 89 = 0 THEN 0 ELSE rank END AS risk_rank FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY p1 DESC, entity) AS rank FROM scores))"""


@plan("risk_tape_audit", "S19 K1", ("scores",), RT + f"""SELECT 'required_schema' AS "check", 'PASS' AS status, 0::BIGINT AS violations UNION ALL SELECT 'decision_time_parseable', 'PASS', 0
UNION ALL SELECT 'decision_time_coverage', 'WARN', count(*) FROM rt WHERE decision_t < {T0} + {D} OR decision_t > {T0} + 25*{D} UNION ALL SELECT 'finite_risk_score', 'FAIL', count(*) FROM rt WHERE risk_score IS NULL
UNION ALL SELECT 'positive_risk_rank', 'FAIL', count(*) FROM rt WHERE risk_rank < 1 UNION ALL SELECT 'unique_decision_entity', 'PASS', 0 UNION ALL SELECT 'out_of_fold_provenance', 'BLOCKED', 0 UNION ALL SELECT 'leakage_cutoff', 'PASS', 0""")
def _(c):
    r = R.risk_rank(c.tape, "p1")
    e, b = F.col("entity"), F.col("bin")
    tape = r.select(F.col("t").alias("decision_t"), "entity", F.when((e * 31 + b) % 97 != 0, F.col("p1")).alias("risk_score"),
                    F.when((e + b) % 89 == 0, 0).otherwise(F.col("rank")).alias("risk_rank"), (F.col("t") - 600_000_000).alias("feature_cutoff_t"))
    return A.audit_risk_tape(tape, T0 + DAY, T0 + 25 * DAY)


@plan("score_tape_audit", "S20", ("scores",), """x AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY p1 DESC, entity) AS r FROM scores WHERE NOT (entity = 3 AND bin % 20 = 0)),
p AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE (entity * 7 + bin) % 301 = 0) AS bs, count(*) FILTER (WHERE bin % 13 = 0 AND r IN (2, 3)) AS dupr FROM x WHERE bin <> 50 GROUP BY 1)
SELECT 'full_population' AS "check", 'FAIL' AS status, count(*) FILTER (WHERE n <> (SELECT count(DISTINCT entity) FROM scores)) AS violations FROM p UNION ALL SELECT 'contiguous_cadence', 'FAIL', 1
UNION ALL SELECT 'score_in_unit_interval', CASE WHEN sum(bs) > 0 THEN 'FAIL' ELSE 'PASS' END, sum(bs)::BIGINT FROM p UNION ALL SELECT 'rank_is_permutation', 'FAIL', count(*) FILTER (WHERE dupr > 0) FROM p UNION ALL SELECT 'top_flag', 'PASS', 0 UNION ALL SELECT 'cutoff_offset', 'PASS', 0""")
def _(c):
    s = R.risk_rank(c.tape.where(~((F.col("entity") == 3) & (F.col("bin") % 20 == 0))), "p1").where(F.col("bin") != 50)
    tape = s.select("entity", "t", F.when((F.col("entity") * 7 + F.col("bin")) % 301 == 0, F.lit(1.5)).otherwise(F.col("p1")).alias("score"),
                    F.when((F.col("bin") % 13 == 0) & (F.col("rank") == 3), 2).otherwise(F.col("rank")).alias("rank"),
                    (F.when((F.col("bin") % 13 == 0) & (F.col("rank") == 3), 2).otherwise(F.col("rank")) <= 20).alias("in_top"),
                    (F.col("t") - 600_000_000).alias("feature_cutoff_t"))
    return A.audit_score_tape(tape, A.expected_population(c.telemetry, "entity"), 6 * HOUR, 20, 600_000_000)


@plan("prediction_parity", "S22", ("scores",), "SELECT count(*) AS rows, count(*) FILTER (WHERE bin = 7) AS unmatched, 0.5::DOUBLE AS max_diff, count(*) FILTER (WHERE bin % 11 = 0) AS beyond_tolerance FROM scores", "max_diff")
def _(c):
    s = c.tape
    other = s.where(F.col("bin") != 7).select("entity", "bin", (F.col("p1") + F.when(F.col("bin") % 11 == 0, 0.5).otherwise(0.0)).alias("p1"))
    return A.prediction_parity(s, other, ["entity", "bin"], "p1", 1e-6)


@plan("fusion_identity", "E23", ("scores",), "SELECT count(*) AS rows, count(*) FILTER (WHERE bin % 17 = 0) AS violations FROM scores")
def _(c):
    w = pareto_weight("k", 1.0, 0.6, None)
    want = w * F.col("p1") + (1 - w) * F.col("p2")
    s = c.scores.withColumn("fused", want + F.when(F.col("bin") % 17 == 0, 0.01).otherwise(0.0))
    return A.identity_check(s, "fused", want)


@plan("reaggregate_check", "E22", ("scores",), "SELECT origin, origin % 5 = 0 AS violation FROM scores GROUP BY 1")
def _(c):
    p = c.tape.groupBy("origin", "bin").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    s = c.tape.groupBy("origin").agg((F.sum("label") + F.when(F.col("origin") % 5 == 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    return A.reaggregate_check(p, s, ["origin"], ["pos", "n"])


@plan("leakage_checks", "E24 P20", ("scores",), """SELECT origin, latest_train_bin, latest_train_bin > origin - 6 AS purge_violation, latest_train_bin + 4 > origin AS immature_label
 FROM (SELECT origin * 4 AS origin, max(bin) - 4 - CASE WHEN origin % 6 = 0 THEN 1 ELSE 7 END AS latest_train_bin FROM scores GROUP BY origin) WHERE latest_train_bin > origin - 6 OR latest_train_bin + 4 > origin""")
def _(c):
    tr = c.decisions.groupBy(F.floor(F.col("bin") / 4).alias("o")).agg(F.max("bin").alias("m"))
    tr = tr.select((F.col("o") * 4).alias("origin"), (F.col("m") - 4 - F.when(F.col("o") % 6 == 0, 1).otherwise(7)).alias("latest_train_bin"))
    return A.leakage_checks(tr, 6, 4)


@plan("duplicate_keys", "T11 U2", ("tel",), f"SELECT entity, (t - {T0}) // {H} AS hr, count(*) AS copies FROM tel GROUP BY 1, 2 HAVING count(*) > 1")
def _(c):
    from ..functions.scalar import bin_index
    return A.duplicates(c.telemetry.select("entity", bin_index("t", T0, HOUR).alias("hr")), ["entity", "hr"])


# ---- sources and sinks: files that Spark derives from the tables ---------------------

def wide_file(c, label, value):
    """The telemetry as a wide CSV: one column per slot, empty where a slot has no reading."""
    path = scratch_path(c.spark, label)
    ts = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    cols = [F.when(F.col("slot") == i, value).alias(f"node-{i}") for i in range(8)]
    src = c.log.withColumn("slot", F.pmod("entity", F.lit(8))) if label == "faultlog" else c.telemetry
    src.select(ts.alias("Time"), *cols).write.option("header", True).csv(path)
    return path


@plan("wide_csv_scan", "S1 F1 P1", ("tel",), "SELECT 'node-' || slot AS entity, slot, t, util AS value FROM tel", "value")
def _(c):
    d = readers.read_wide_csv(c.spark, wide_file(c, "wide", F.col("util")))
    return d.where(F.col("value").isNotNull()).select("entity", F.substring_index("entity", "-", -1).cast("bigint").alias("slot"), F.unix_micros("ts").alias("t"), "value")


@plan("fault_log_scan", "S2 P4", ("flog",), "SELECT 'node-' || (entity % 8) AS entity, t, code::BIGINT AS code FROM flog WHERE code > 0")
def _(c):
    d = readers.read_fault_log(c.spark, wide_file(c, "faultlog", F.col("code")))
    return d.select("entity", F.unix_micros("ts").alias("t"), "code")


@plan("telemetry_parquet_scan", "S3 J2", ("binned",), f"SELECT entity, bin, util_mean, temp_mean FROM binned WHERE bin >= 20 AND bin < 60", "util_mean temp_mean")
def _(c):
    base = scratch_path(c.spark, "telemetry")
    for m in ("util", "temp"):
        c.binned.select(F.timestamp_micros(F.lit(T0) + F.col("bin") * c.step).alias("Time_5m"), F.col("entity").cast("string").alias("gpu_id"),
                        f"{m}_mean", F.col(f"{m}_n").alias(f"{m}_obs")).write.parquet(f"{base}/{m}.parquet")
    import datetime as dt
    lo = dt.datetime.fromtimestamp((T0 + 20 * c.step) / 1e6, dt.timezone.utc)
    hi = dt.datetime.fromtimestamp((T0 + 60 * c.step) / 1e6, dt.timezone.utc)
    f = readers.read_telemetry(c.spark, base, ["util", "temp"], lo, hi)
    j = f["util"].join(f["temp"], ["entity", "ts"])
    return j.select(F.col("entity").cast("bigint").alias("entity"), F.call_function("div", F.unix_micros("ts") - T0, F.lit(c.step)).alias("bin"), "util_mean", "temp_mean")


@plan("onset_ledger_scan", "S5 U2", ("faults",), "SELECT entity, t, code FROM faults")
def _(c):
    path = scratch_path(c.spark, "onsets")
    o = c.faults.select(F.col("entity").alias("gpu_id"), F.timestamp_micros("t").alias("onset_time"), F.col("code").alias("xid_code"))
    o.unionByName(o.where(F.col("gpu_id") % 3 == 0)).write.parquet(path)
    return readers.read_onsets(c.spark, path).select("entity", F.unix_micros("ts").alias("t"), "code")


@plan("job_trace_scan", "S6 F1", ("jobs",), """SELECT job_id::VARCHAR AS job_id, CASE WHEN job_id % 10 = 0 THEN -1 ELSE submit_t END AS submit_t, start_t, end_t, gpu_num, state FROM jobs""")
def _(c):
    path = scratch_path(c.spark, "jobs")
    txt = lambda x: F.date_format(F.timestamp_micros(x), "yyyy-MM-dd HH:mm:ss")
    c.jobs.select("job_id", F.when(F.col("job_id") % 10 == 0, "not a time").otherwise(txt("submit_t")).alias("submit_time"), txt("start_t").alias("start_time"),
                  txt("end_t").alias("end_time"), "duration", "gpu_time", "gpu_num", "node_num", "cpu_num", "type", "user", "state", F.lit("q").alias("queue")
                  ).write.option("header", True).csv(path)
    d = readers.read_jobs(c.spark, path)
    return d.select("job_id", F.coalesce(F.unix_micros("submit_time"), F.lit(-1)).alias("submit_t"), F.unix_micros("start_time").alias("start_t"),
                    F.unix_micros("end_time").alias("end_t"), "gpu_num", "state")


@plan("node_power_scan", "S7 P2", ("tel",), f"""SELECT '10.140.0.' || grp AS node, (t - {T0}) // {H} AS hr, avg(CASE WHEN power > 0 THEN power END) AS power, count(*) AS rows FROM tel WHERE event_id % 20 <> 0 GROUP BY 1, 2""", "power")
def _(c):
    from ..functions.scalar import bin_index
    p = [scratch_path(c.spark, "power"), scratch_path(c.spark, "power")]
    fmt = F.when(F.col("event_id") % 20 == 0, "bad").otherwise(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    rows = c.telemetry.select(fmt.alias("Time"), F.col("power").alias("Sys_Total_Power"), F.format_string("SH-IDC1-10-140-0-%d", "grp").alias("node"), "event_id")
    for i, path in enumerate(p):
        rows.where(F.col("event_id") % 2 == i).drop("event_id").write.option("header", True).csv(path)
    d = readers.read_node_power(c.spark, p)
    return d.groupBy("node", bin_index(F.unix_micros("ts"), T0, HOUR).alias("hr")).agg(F.avg("power").alias("power"), F.count("*").alias("rows"))


@plan("malformed_rows", "S8", ("tel",), "SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 50 = 0) AS malformed, count(*) AS parsed_entity, count(*) AS parsed_t, count(*) AS parsed_x FROM tel")
def _(c):
    path = scratch_path(c.spark, "lines")
    line = F.concat_ws(",", F.col("entity").cast("string"), F.col("t").cast("string"), F.when(F.col("event_id") % 50 == 0, "1,2,3").otherwise("1"))
    c.telemetry.select(line).write.text(path)
    schema = T.StructType([T.StructField("entity", T.LongType()), T.StructField("t", T.LongType()), T.StructField("x", T.LongType())])
    return readers.malformed_rows(readers.read_with_corrupt(c.spark, path, schema, header=False))


@plan("tape_roundtrip", "S16 U1", ("scores",), "SELECT origin, count(*) AS rows, sum(label)::BIGINT AS positives FROM scores GROUP BY 1")
def _(c):
    cut = F.col("origin") < 10  # written in two goes, as a resumed run does
    path = writers.write_tape(c.tape.where(cut), scratch_path(c.spark, "tape"), "origin", ["bin", "entity"])
    writers.write_tape(c.tape.where(~cut), path, "origin", ["bin", "entity"])
    return c.spark.read.parquet(path).groupBy(F.col("origin").cast("bigint").alias("origin")).agg(F.count("*").alias("rows"), F.sum("label").alias("positives"))


@plan("csv_summary_roundtrip", "S17", ("faults",), "SELECT code, count(*) AS n FROM faults GROUP BY 1")
def _(c):
    path = writers.write_csv(c.faults.groupBy("code").agg(F.count("*").alias("n")), scratch_path(c.spark, "summary"))
    return c.spark.read.schema("code bigint, n bigint").option("header", True).csv(path)


@plan("stage_reuse", "S21", ("binned",), "SELECT count(*) AS rows, false AS first_reused, true AS second_reused, false AS changed_reused FROM binned")
def _(c):
    path = scratch_path(c.spark, "stage")
    key = c.telemetry.drop("event_type", "event_id")
    _, a = writers.reuse_or_build(c.spark, path, lambda: c.binned, key)
    d, b = writers.reuse_or_build(c.spark, path, lambda: c.binned, key)
    other = key.withColumn("util", F.when(F.col("t") == key.agg(F.max("t")).scalar(), F.col("util") + 1).otherwise(F.col("util")))
    _, x = writers.reuse_or_build(c.spark, path, lambda: c.binned, other)
    return d.agg(F.count("*").alias("rows")).select("rows", F.lit(a).alias("first_reused"), F.lit(b).alias("second_reused"), F.lit(x).alias("changed_reused"))


@plan("resume_partitions", "T12 M12", ("scores",), "SELECT DISTINCT origin FROM scores WHERE origin >= 10")
def _(c):
    s = c.tape
    path = writers.write_tape(s.where(F.col("origin") < 10), scratch_path(c.spark, "resume"), "origin")
    return writers.missing_partitions(c.spark, path, "origin", s)


@plan("risk_tape", "S16 S19 W10", ("scores",), f"""SELECT t AS decision_t, entity, p1 AS risk_score, row_number() OVER (PARTITION BY bin ORDER BY p1 DESC, entity) AS risk_rank, CASE WHEN bin >= 60 THEN 'late' ELSE 'early' END AS model_fold, t - 600000000 AS feature_cutoff_t FROM scores""", "risk_score")
def _(c):
    obs = c.grid.select("entity", "bin", (F.col("util_n") / 2).alias("observability"))
    r = R.risk_rank(c.tape, "p1").withColumn("score", F.col("p1")).withColumn("fold", F.when(F.col("bin") >= 60, "late").otherwise("early"))
    return Tp.risk_tape(r, obs).drop("observability")
