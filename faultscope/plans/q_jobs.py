"""Job trace, distribution summaries and resampling."""

from pyspark.sql import functions as F

from ..canonical import T0
from ..functions.scalar import DAY, HOUR, bin_index, mix_hash_sql
from ..operators import bootstrap as B
from ..operators import jobs as Jb
from ..operators import summaries as Sm
from .oracle import D, H
from .registry import plan

W0, W1 = 852_076_800_000_000, 978_307_200_000_000  # 1997-01-01, 2001-01-01


@plan("job_quality", "S6 P5", ("jobs",), f"""SELECT job_id, (start_t - submit_t) / 1000000.0::DOUBLE AS wait_s, (end_t - start_t) / 1000000.0::DOUBLE AS runtime_s,
 duration - (end_t - start_t) / 1000000.0::DOUBLE AS duration_gap_s, gpu_time - duration * gpu_num AS gpu_time_gap, submit_t // {D} AS submit_day FROM jobs""", "wait_s runtime_s duration_gap_s gpu_time_gap")
def _(c):
    return Jb.quality(c.jobs).select("job_id", "wait_s", "runtime_s", "duration_gap_s", "gpu_time_gap", "submit_day")


ELIG = f"""el AS (SELECT *, submit_t BETWEEN {W0} AND {W1} AS in_window, gpu_num > 0 AS uses_gpu, state = 'COMPLETED' AS completed, duration > 0 AS has_duration,
 gpu_num <= 6 AS fits_cluster, gpu_num <= node_num * 8 AS fits_nodes FROM jobs), e2 AS (SELECT *, in_window AND uses_gpu AND completed AND has_duration AND fits_cluster AND fits_nodes AS eligible FROM el)
"""


def elig(c):
    return Jb.eligibility(c.jobs, W0, W1, 6)


@plan("job_eligibility", "P6", ("jobs",), ELIG + "SELECT job_id, in_window, uses_gpu, completed, has_duration, fits_cluster, fits_nodes, eligible FROM e2")
def _(c):
    return elig(c).select("job_id", "in_window", "uses_gpu", "completed", "has_duration", "fits_cluster", "fits_nodes", "eligible")


@plan("job_tape", "P7", ("jobs",), ELIG + f"""SELECT job_id, submit_t, (submit_t - {W0}) // 1000000 AS arrival_s, floor(duration)::BIGINT AS duration_s, gpu_num, node_num, cpu_num, type, "user", state AS historical_state FROM e2 WHERE eligible""")
def _(c):
    return Jb.job_tape(elig(c), W0)


@plan("daily_jobs", "A9", ("jobs",), f"""SELECT submit_t // {D} AS submit_day, count(*) AS jobs, sum(gpu_num)::BIGINT AS gpus, median((start_t - submit_t) / 1000000.0::DOUBLE) AS median_wait_s, sum(gpu_time) / 3600 AS gpu_hours,
 count(*) FILTER (WHERE state = 'FAILED') AS failed, avg((state = 'FAILED')::INT) AS failed_rate FROM jobs GROUP BY 1""", "median_wait_s gpu_hours failed_rate")
def _(c):
    return Jb.daily(c.jobs)


@plan("value_counts", "A10", ("jobs",), "SELECT CASE WHEN type LIKE '5%' THEN NULL ELSE type END AS value, count(*) AS rows, count(*) / (SELECT count(*) FROM jobs)::DOUBLE AS share FROM jobs GROUP BY 1", "share")
def _(c):
    return Jb.value_counts(c.jobs.withColumn("type", F.when(~F.col("type").startswith("5"), F.col("type"))), "type")


def desc_sql(x):
    return (f"SELECT '{x}' AS col, count({x}) AS n, avg({x})::DOUBLE AS mean, stddev_samp({x}) AS std, min({x})::DOUBLE AS lo, quantile_cont({x}, 0.5)::DOUBLE AS p50, quantile_cont({x}, 0.9)::DOUBLE AS p90,"
            f" quantile_cont({x}, 0.95)::DOUBLE AS p95, quantile_cont({x}, 0.99)::DOUBLE AS p99, max({x})::DOUBLE AS hi FROM jobs")


@plan("numeric_describe", "A11", ("jobs",), " UNION ALL ".join(desc_sql(x) for x in ("duration", "gpu_num", "gpu_time")), "mean std lo p50 p90 p95 p99 hi", digits=3)
def _(c):
    return Jb.describe(c.jobs, ["duration", "gpu_num", "gpu_time"])


@plan("selection_bias", "A29", ("jobs",), ELIG + """SELECT CASE WHEN eligible THEN 'eligible' ELSE 'excluded' END AS side, count(*) AS jobs, sum(gpu_time) / 3600 AS gpu_hours, quantile_cont(duration, 0.5) AS duration_p50, quantile_cont(duration, 0.95) AS duration_p95,
 avg((gpu_num > 1)::INT) AS multi_gpu_share FROM e2 GROUP BY 1""", "gpu_hours duration_p50 duration_p95 multi_gpu_share")
def _(c):
    return Jb.selection_bias(elig(c))


@plan("job_sizes", "A30", ("jobs",), """SELECT gpu_num, node_num, count(*) AS jobs, sum(gpu_num)::BIGINT AS gpus, median(duration) AS median_duration, avg((state = 'FAILED')::INT) AS failed_rate FROM jobs GROUP BY 1, 2""", "median_duration failed_rate")
def _(c):
    return Jb.summaries(c.jobs, ["gpu_num", "node_num"])


@plan("offered_load", "A31", ("jobs",), f"""d AS (SELECT submit_t // {D} AS day, sum(duration * gpu_num) / (64 * 86400.0) AS l FROM jobs GROUP BY 1)
SELECT count(*) AS days, quantile_cont(l, 0.5) AS median_load, quantile_cont(l, 0.95) AS p95_load, max(l) AS max_load FROM d""", "median_load p95_load max_load")
def _(c):
    return Jb.offered_load(c.jobs, 64)


@plan("entity_summary", "A1", ("tel",), """SELECT entity, count(*) AS samples, count(x) AS valid, 1 - count(x) / count(*)::DOUBLE AS missing_rate, count(*) FILTER (WHERE x = 0) / count(x)::DOUBLE AS zero_rate, avg(x) AS mean, stddev_pop(x) AS std,
 min(x) AS min, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, max(x) AS max FROM (SELECT entity, CASE WHEN event_type <> 'signup' THEN temp END AS x FROM tel) GROUP BY 1""",
      "missing_rate zero_rate mean std min p50 p95 p99 max")
def _(c):
    d = c.telemetry.withColumn("x", F.when(F.col("event_type") != "signup", F.col("temp")))
    return Sm.entity_summary(d, "entity", "x")


@plan("time_summary", "A2", ("tel",), f"""SELECT (t - {T0}) // {H} AS hr, count(temp) AS observed, avg(temp) AS mean, quantile_cont(temp, 0.5) AS p50, quantile_cont(temp, 0.95) AS p95, quantile_cont(temp, 0.99) AS p99 FROM tel GROUP BY 1""", "mean p50 p95 p99")
def _(c):
    return Sm.time_summary(c.telemetry.withColumn("hr", bin_index("t", T0, HOUR)), "hr", "temp")


@plan("missingness", "A3 S2", ("flog",), "SELECT entity, count(*) AS rows, count(*) FILTER (WHERE code IS NULL) AS missing, count(*) FILTER (WHERE code IS NULL) / count(*)::DOUBLE AS missing_rate FROM flog GROUP BY 1", "missing_rate")
def _(c):
    return Sm.missingness(c.log, "entity", "code")


@plan("bootstrap_median", "A22", ("tel",), f"""u AS (SELECT slot, grp, median(temp) AS v FROM tel GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY v) AS pos, count(*) OVER (PARTITION BY slot) AS n FROM u WHERE v IS NOT NULL),
dr AS (SELECT slot, rep, ({mix_hash_sql(42, 'rep', 'pos')} % n) + 1 AS pos FROM p, (SELECT unnest(range(0, 200)) AS rep)),
m AS (SELECT slot, rep, median(v) AS s FROM dr JOIN (SELECT slot, pos, v FROM p) USING (slot, pos) GROUP BY 1, 2)
SELECT slot, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high FROM m GROUP BY 1""", "ci_low ci_high")
def _(c):
    u = Sm.exact_percentiles(c.telemetry, ["slot", "grp"], "temp", {"v": 0.5})
    return B.bootstrap_ci(u, ["slot"], "v", reps=200)


@plan("block_bootstrap", "A23", ("scores",), f"""o AS (SELECT origin, avg(p1) - avg(p2) AS d, sum(label) AS y FROM scores GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY origin) AS pos, count(*) OVER () AS n FROM o),
b AS (SELECT rep, b, i, n, {mix_hash_sql(42, 'rep', 'b')} % greatest(n - 3 + 1, 1) AS s FROM (SELECT max(n) AS n FROM p), (SELECT unnest(range(0, 300)) AS rep), (SELECT unnest(range(0, 40)) AS b), (SELECT unnest(range(0, 3)) AS i) WHERE b <= (n - 1) // 3 AND b * 3 + i < n),
r AS (SELECT rep, count(*) AS u, sum(d) AS sd, sum(y) AS sy FROM b JOIN p ON p.pos = b.s + b.i + 1 GROUP BY 1)
SELECT quantile_cont(sd / u, 0.025) AS ap_low, quantile_cont(sd / u, 0.975) AS ap_high, avg(sy) AS mean_positives, min(u)::BIGINT AS units FROM r""", "ap_low ap_high mean_positives")
def _(c):
    o = c.scores.groupBy("origin").agg((F.avg("p1") - F.avg("p2")).alias("d"), F.sum("label").alias("y"))
    r = B.block_bootstrap(o, "origin", 3, 300, {"sd": F.col("d"), "sy": F.col("y")})
    q = F.percentile(F.col("sd") / F.col("units"), F.array(F.lit(0.025), F.lit(0.975)))
    return r.agg(q[0].alias("ap_low"), q[1].alias("ap_high"), F.avg("sy").alias("mean_positives"), F.min("units").alias("units"))
