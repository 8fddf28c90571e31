"""Samples, weights, priors, standardisation and controllers."""

from pyspark.sql import functions as F

from ..canonical import T0
from ..functions.scalar import DAY, HOUR, bin_index, mix_hash_sql, recency_weight
from ..operators import control as C
from ..operators import metrics as M
from ..operators import sampling as S
from .oracle import D, H, STEP, at
from .q_ranking import ap_sql
from .registry import plan


def hsh(seed):
    return mix_hash_sql(seed, "entity", "bin")


SN = f"""ps AS (SELECT *, {hsh(11)} AS h, sum(label) OVER (PARTITION BY origin) AS p FROM scores), ng AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY h, entity, bin) AS r FROM ps WHERE label = 0),
smp AS (SELECT entity, bin, origin, label, p1, p2 FROM ps WHERE label = 1 UNION ALL SELECT entity, bin, origin, label, p1, p2 FROM ng WHERE r <= least(60, floor(p * 1.5)))
"""


def sample(c):
    return S.sample_negatives(c.tape, ["origin"], "label", 1.5, 60, ["entity", "bin"], 11)


@plan("negative_sampling", "L7", ("scores",), SN + "SELECT entity, bin, origin, label FROM smp")
def _(c):
    return sample(c).select("entity", "bin", "origin", "label")


@plan("positive_thinning", "L6", ("faults",), f"SELECT DISTINCT entity, unnest(range((t - {T0}) // {STEP} - 12, (t - {T0}) // {STEP} + 1, 6)) AS bin FROM faults")
def _(c):
    return S.thin_positives(c.faults.select("entity", bin_index("t", T0, c.step).alias("bin")), 12, 6)


@plan("validation_subset", "L10", ("scores",), f"""ng AS (SELECT *, row_number() OVER (ORDER BY {hsh(5)}, entity, bin) AS r FROM scores WHERE label = 0),
lo AS (SELECT greatest(0, count(*) FILTER (WHERE label = 0) - greatest(0, 9000 - sum(label)))::BIGINT AS left_out FROM scores)
SELECT entity, bin, label, left_out FROM scores, lo WHERE label = 1 UNION ALL SELECT entity, bin, label, left_out FROM ng, lo WHERE r <= greatest(0, 9000 - (SELECT sum(label) FROM scores))""")
def _(c):
    return S.validation_subset(c.tape, "label", 9000, ["entity", "bin"], 5).select("entity", "bin", "label", "left_out")


@plan("time_sampling", "L11", ("decisions",), f"SELECT t FROM (SELECT t, row_number() OVER (ORDER BY {mix_hash_sql(3, 't')}, t) AS r FROM (SELECT DISTINCT t FROM decisions)) WHERE r <= 40")
def _(c):
    return S.sample_times(c.decisions, "t", 40, 3)


@plan("multi_head_sampling", "L12 L4", ("scores",), f"""hd AS (SELECT *, label AS l1, (label = 1 AND bin % 2 = 0)::BIGINT AS l2 FROM scores), ng AS (SELECT *, row_number() OVER (ORDER BY {hsh(9)}, entity, bin) AS r FROM hd WHERE greatest(l1, l2) = 0)
SELECT entity, bin, l1, l2 FROM hd WHERE greatest(l1, l2) = 1 UNION ALL SELECT entity, bin, l1, l2 FROM ng WHERE r <= least(5000, floor((SELECT sum(greatest(l1, l2)) FROM hd) * 0.5))""")
def _(c):
    d = c.tape.withColumns({"l1": F.col("label"), "l2": F.when(F.col("bin") % 2 == 0, F.col("label")).otherwise(0).cast("bigint")})
    return S.sample_multi(d, ["l1", "l2"], 0.5, 5000, ["entity", "bin"], 9).select("entity", "bin", "l1", "l2")


@plan("sample_summary", "L8 L9", ("scores", "grid"), """SELECT count(*) AS rows, count(*) FILTER (WHERE util_n > 0) AS eligible, count(*) FILTER (WHERE util_n = 0) AS censored, sum(label) FILTER (WHERE util_n > 0)::BIGINT AS positives, avg(label) FILTER (WHERE util_n > 0) AS prevalence
 FROM scores JOIN grid USING (entity, bin)""", "prevalence")
def _(c):
    from ..operators.labels import label_future
    d = label_future(c.grid.withColumn("t", F.lit(T0) + F.col("bin") * F.lit(c.step)), c.faults, bounds=c.bounds).withColumn("ok", F.col("util_n") > 0)
    return S.sample_summary(d, "label", "ok")


@plan("class_weights", "F18 F17", ("scores",), """z AS (SELECT max(bin) AS top FROM scores), a AS (SELECT sum(label) AS p, count(*) AS n, avg(exp(-ln(2) * (top - bin) / 4.0 / 7)) AS m FROM scores, z)
SELECT entity, bin, CASE WHEN label = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END AS weight, exp(-ln(2) * (top - bin) / 4.0 / 7) / m AS recency FROM scores, a, z""", "weight recency")
def _(c):
    d = S.class_weight(c.tape, "label").withColumn("age", (c.span["hi"] - F.col("bin")) / 4.0)
    m = d.agg(F.avg(recency_weight("age", 7.0)))
    return d.select("entity", "bin", "weight", (recency_weight("age", 7.0) / m.scalar()).alias("recency"))


@plan("case_control_weights", "F18 L7", ("scores",), SN + "SELECT entity, bin, CASE WHEN label = 1 THEN 1.0 ELSE (SELECT count(*) FROM scores WHERE label = 0) / (SELECT count(*) FROM smp WHERE label = 0)::DOUBLE END AS weight FROM smp", "weight")
def _(c):
    return S.case_control_weight(sample(c), c.tape, "label").select("entity", "bin", "weight")


@plan("priors", "A43", ("scores",), SN + "SELECT origin, (SELECT avg(s.label) FROM scores s WHERE s.origin = smp.origin) AS true_prior, avg(label) AS sample_prior, count(*) AS samples FROM smp GROUP BY origin", "true_prior sample_prior")
def _(c):
    return S.priors(c.tape, sample(c), ["origin"])


@plan("standardize", "F19 F20", ("grid",), f"""a AS (SELECT avg(util_mean) AS mu, stddev_pop(util_mean) AS su, avg(temp_mean) AS mt, stddev_pop(temp_mean) AS st, quantile_cont(temp_mean, 0.5) AS qt FROM grid WHERE bin < {at(2, 3, 'grid')})
SELECT entity, bin, (coalesce(util_mean, mu) - mu) / su AS util_z, (coalesce(temp_mean, mt) - mt) / st AS temp_z, coalesce(temp_mean, qt) AS temp_filled FROM grid, a""", "util_z temp_z temp_filled")
def _(c):
    d = c.grid.select("entity", "bin", F.col("util_mean").alias("util"), F.col("temp_mean").alias("temp"))
    train = F.col("bin") < c.at(2, 3)
    d = S.standardize(d, train, ["util", "temp"]).withColumn("temp_filled", F.col("temp"))
    return S.impute_median(d, train, ["temp_filled"]).select("entity", "bin", "util_z", "temp_z", "temp_filled")


# ---- controllers on per-origin blocks --------------------------------------------------

BL = ap_sql(["origin"], "p1") + """, q2 AS (SELECT origin, sum((pos * tp) / seen::DOUBLE) / sum(pos) AS ap2 FROM (SELECT *, sum(pos) OVER (PARTITION BY origin ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY origin ORDER BY s DESC) AS seen
  FROM (SELECT origin, p2 AS s, sum(label) AS pos, count(*) AS n FROM scores GROUP BY 1, 2)) GROUP BY 1),
bl0 AS (SELECT origin, ap, coalesce(ap2, 0) AS ap2, positives / rows::DOUBLE AS prev FROM q LEFT JOIN q2 USING (origin)),
bl AS (SELECT origin, greatest(0.0, least(1.0, (ap - prev) / greatest(1 - prev, 1e-9))) AS n1, greatest(0.0, least(1.0, (ap2 - prev) / greatest(1 - prev, 1e-9))) AS n2 FROM bl0)
"""


def blocks(c):
    from ..functions.scalar import norm_ap
    from ..session import materialize
    long = M.unpivot_models(c.tape, ["entity", "origin", "label"], ["p1", "p2"])
    q = M.ranking_quality(long, ["model", "origin"], "score", "label")
    w = q.groupBy("origin").agg(F.max(F.when(F.col("model") == "p1", F.col("ap"))).alias("ap"), F.max(F.when(F.col("model") == "p2", F.col("ap"))).alias("ap2"),
                                F.max(F.col("positives") / F.col("rows")).alias("prev"))
    return materialize(w.select("origin", norm_ap("ap", F.col("prev")).alias("n1"), norm_ap("ap2", F.col("prev")).alias("n2"), "ap", "ap2", "prev"), "blocks")


@plan("recent_drop", "W24 W35 F16 E10", ("scores",), BL + """SELECT origin, n1, CASE WHEN avg(n1) OVER p IS NULL THEN 0.0 ELSE greatest(0.0, (avg(n1) OVER p - avg(n1) OVER r) / greatest(abs(avg(n1) OVER p), 1e-4)) END AS "drop",
 avg(n2) OVER (ORDER BY origin ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS n2_recent FROM bl WINDOW r AS (ORDER BY origin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), p AS (ORDER BY origin ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)""", 'n1 "drop" n2_recent')
def _(c):
    d = C.recent_context(C.recent_drop(blocks(c).select("origin", "n1", "n2"), "n1"), ["n2"])
    return d.select("origin", "n1", "drop", "n2_recent")


REL = """rl AS (SELECT origin, avg({v}) OVER c AS m, 1 / (1 + stddev_pop({v}) OVER c / greatest(abs(avg({v}) OVER c), 1e-4)) AS st, avg({v}) OVER o AS pm FROM bl
 WINDOW c AS (ORDER BY origin ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), o AS (ORDER BY origin ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)),
rd AS (SELECT *, CASE WHEN pm IS NULL THEN 0.0 ELSE greatest(0.0, (pm - m) / greatest(abs(pm), 1e-4)) END AS dr FROM rl), re AS (SELECT *, greatest(0.0, least(1.0, 0.6 * m + 0.3 * st + 0.1 * (1 - dr))) AS rel FROM rd)
"""


def rel(v, t):
    s = REL.replace("{v}", v)
    for n in ("rl", "rd", "re"):
        s = s.replace(f"{n} AS (", f"{n}{t} AS (").replace(f"FROM {n})", f"FROM {n}{t})")
    return s


@plan("branch_reliability", "W25", ("scores",), BL + ", " + rel("n1", "1") + "SELECT origin, st AS n1_stability, dr AS n1_drop, rel AS n1_reliability FROM re1", "n1_stability n1_drop n1_reliability")
def _(c):
    return C.branch_reliability(blocks(c).select("origin", "n1"), "n1", "n1").select("origin", "n1_stability", "n1_drop", "n1_reliability")


@plan("window_controller", "M20", ("scores",), BL + """, dr AS (SELECT origin, row_number() OVER (ORDER BY origin) AS r, CASE WHEN avg(n1) OVER p IS NULL THEN 0.0 ELSE greatest(0.0, (avg(n1) OVER p - avg(n1) OVER c) / greatest(abs(avg(n1) OVER p), 1e-4)) END AS d
 FROM bl WINDOW c AS (ORDER BY origin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), p AS (ORDER BY origin ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS origin, 1 AS idx, 0 AS stable, 'start' AS action UNION ALL
 SELECT dr.r, dr.origin, CASE WHEN d >= 0.15 AND idx > 0 THEN idx - 1 WHEN d < 0.15 AND stable + 1 >= 3 AND idx < 2 THEN idx + 1 ELSE idx END, CASE WHEN d >= 0.15 OR (stable + 1 >= 3 AND idx < 2) THEN 0 ELSE stable + 1 END,
 CASE WHEN d >= 0.15 AND idx > 0 THEN 'shrink' WHEN d >= 0.15 THEN 'hold_min' WHEN stable + 1 >= 3 AND idx < 2 THEN 'expand' ELSE 'hold' END FROM f JOIN dr ON dr.r = f.r + 1)
SELECT origin, (7 * (idx + 1))::BIGINT AS next_days, stable::BIGINT AS stable, action FROM f WHERE r > 0""")
def _(c):
    return C.window_controller(blocks(c), "n1")


@plan("reliability_gate", "M22", ("scores",), BL + ", " + rel("n1", "1") + ", " + rel("n2", "2") + """, g AS (SELECT a.origin, row_number() OVER (ORDER BY a.origin) AS r, a.rel - b.rel AS dl, a.dr >= 0.2 AND a.dr > b.dr AS d1, b.dr >= 0.2 AND b.dr > a.dr AS d2 FROM re1 a JOIN re2 b USING (origin)),
h AS (SELECT *, CASE WHEN d1 THEN -1 WHEN d2 THEN 1 WHEN dl >= 0.03 THEN 1 WHEN dl <= -0.03 THEN -1 ELSE 0 END AS dir, least(1.0, abs(dl) / 0.2) AS conf FROM g),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS origin, 0.5::DOUBLE AS w, 0 AS pending, 0 AS streak UNION ALL
 SELECT r, origin, greatest(0.2, least(0.8, w + greatest(-0.1, least(0.1, greatest(0.2, least(0.8, CASE WHEN dir = 0 THEN 0.5 WHEN NOT (ns >= 2 OR d1 OR d2) THEN w WHEN d1 THEN 0.2 WHEN d2 THEN 0.8 ELSE 0.5 + dir * 0.3 * conf END)) - w)))), dir, ns
 FROM (SELECT h.*, f.w, CASE WHEN h.dir = 0 THEN 0 WHEN h.dir = f.pending THEN f.streak + 1 ELSE 1 END AS ns FROM f JOIN h ON h.r = f.r + 1))
SELECT origin, w AS next_weight_b1, pending::BIGINT AS direction, streak::BIGINT AS streak FROM f WHERE r > 0""", "next_weight_b1")
def _(c):
    return C.reliability_gate(blocks(c), "n1", "n2")


@plan("matured_feedback", "M21 T6", ("bins",), """b AS (SELECT bin // 4 AS block, max(bin) AS latest_score_bin FROM bins GROUP BY 1), o AS (SELECT bin AS origin FROM bins WHERE bin % 4 = 0)
SELECT block, latest_score_bin, coalesce((SELECT min(origin) FROM o WHERE origin >= latest_score_bin + 6), -1) AS applied_at_origin FROM b""")
def _(c):
    b = c.binned.select("bin").distinct()
    blk = b.groupBy(F.floor(F.col("bin") / 4).alias("block")).agg(F.max("bin").alias("latest_score_bin"))
    o = b.where(F.col("bin") % 4 == 0).select(F.col("bin").alias("origin"))
    return C.matured_feedback(blk, o, 6, 4).withColumn("applied_at_origin", F.coalesce("applied_at_origin", F.lit(-1)))


@plan("robust_ap", "A39 A40", ("scores",), BL + """SELECT avg(ap) AS equal_block, sum(ap * mins) / sum(mins) AS time_weighted, avg(ap) AS min_30m, avg(CASE WHEN mins >= 720 THEN ap END) AS min_12h, avg(CASE WHEN mins >= 1440 THEN ap END) AS min_24h
 FROM (SELECT origin, ap, CASE WHEN origin % 3 = 0 THEN 360 WHEN origin % 3 = 1 THEN 720 ELSE 1440 END AS mins FROM bl0)""", "equal_block time_weighted min_30m min_12h min_24h")
def _(c):
    m = F.when(F.col("origin") % 3 == 0, 360).when(F.col("origin") % 3 == 1, 720).otherwise(1440)
    return C.robust_ap(blocks(c).withColumn("mins", m), "ap", "mins")


@plan("arm_contrast", "A40", ("scores",), BL + "SELECT count(*) AS blocks, avg(ap - ap2) AS difference, 100 * avg(ap - ap2) / avg(ap2) AS relative_pct, count(*) FILTER (WHERE ap - ap2 > 1e-12) AS wins, count(*) FILTER (WHERE abs(ap - ap2) <= 1e-12) AS ties, count(*) FILTER (WHERE ap - ap2 < -1e-12) AS losses, median(ap - ap2) AS median_difference FROM bl0",
      "difference relative_pct median_difference")
def _(c):
    b = blocks(c)
    long = b.select("origin", F.explode(F.array(F.struct(F.lit("one").alias("arm"), F.col("ap").alias("v")), F.struct(F.lit("two").alias("arm"), F.col("ap2").alias("v")))).alias("x")).select("origin", "x.*")
    return C.contrast(long, "arm", ["origin"], "v", "one", "two")
