"""Ranks, Top-K lists, metrics, fusion and inertia on the two-branch score table."""

from pyspark.sql import functions as F

from ..canonical import T0
from ..functions import scalar as S
from ..functions.scalar import DAY, HOUR
from ..operators import fusion as U
from ..operators import metrics as M
from ..operators import ranking as R
from ..session import materialize
from .oracle import D, H, at
from .registry import plan


def rk(score="p1", name="rank"):
    return f"row_number() OVER (PARTITION BY bin ORDER BY {score} DESC, entity) AS {name}"


@plan("risk_rank", "W18 K5", ("scores",), f"SELECT entity, bin, p1, {rk()} FROM scores", "p1")
def _(c):
    return R.risk_rank(c.tape, "p1").select("entity", "bin", "p1", "rank")


@plan("topk_per_time", "K1 T8", ("scores",), f"SELECT entity, bin, rank FROM (SELECT *, {rk('p2')} FROM scores) WHERE rank <= 10")
def _(c):
    return R.topk(c.scores, "p2", 10).select("entity", "bin", "rank")


@plan("top_fraction", "K2", ("scores",), f"SELECT entity, bin, rank FROM (SELECT *, {rk()}, count(*) OVER (PARTITION BY bin) AS n FROM scores) WHERE rank <= greatest(1, ceil(n * 0.05::DOUBLE))")
def _(c):
    return R.top_fraction(c.tape, "p1", 0.05).select("entity", "bin", "rank")


@plan("rank_mean", "W19", ("scores",), f"""SELECT entity, bin, ((n - r1 + 1) / n::DOUBLE + (n - r2 + 1) / n::DOUBLE) / 2 AS rank_mean
 FROM (SELECT *, {rk('p1', 'r1')}, {rk('p2', 'r2')}, count(*) OVER (PARTITION BY bin) AS n FROM scores)""", "rank_mean")
def _(c):
    return R.rank_mean(c.tape, ["p1", "p2"]).select("entity", "bin", "rank_mean")


@plan("strict_intersection", "K8", ("scores",), f"""SELECT entity, bin FROM (SELECT *, {rk('p1', 'r1')}, {rk('p2', 'r2')}, count(*) OVER (PARTITION BY bin) AS n FROM scores)
 WHERE r1 <= greatest(1, ceil(n * 0.2::DOUBLE)) AND r2 <= greatest(1, ceil(n * 0.2::DOUBLE))""")
def _(c):
    return R.intersect_topk(c.tape, ["p1", "p2"], 0.2).select("entity", "bin")


@plan("topk_overlap", "U4 E18", ("scores",), f"""a AS (SELECT entity, bin, {rk('p1', 'r1')}, {rk('p2', 'r2')} FROM scores)
SELECT bin, count(*) AS overlap, count(*) FILTER (WHERE r1 = r2) AS same_position FROM a WHERE r1 <= 20 AND r2 <= 20 GROUP BY 1""")
def _(c):
    return R.topk_overlap(R.topk(c.tape, "p1", 20), R.topk(c.tape, "p2", 20))


CHURN = f"""tp AS (SELECT entity, bin FROM (SELECT *, {rk()} FROM scores) WHERE rank <= 20)
"""


@plan("topk_churn", "W23 E14", ("scores",), CHURN + """SELECT bin, count(*) AS members, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tp p WHERE p.entity = tp.entity AND p.bin = tp.bin - 1)) AS entered
 FROM tp WHERE bin - 1 IN (SELECT bin FROM tp) GROUP BY 1""")
def _(c):
    return R.topk_churn(R.topk(c.tape, "p1", 20), 1)


@plan("churn_summary", "E14", ("scores",), CHURN + """, c AS (SELECT bin, count(*) AS members, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tp p WHERE p.entity = tp.entity AND p.bin = tp.bin - 1)) AS entered
 FROM tp WHERE bin - 1 IN (SELECT bin FROM tp) GROUP BY 1)
SELECT sum(entered)::BIGINT AS entries, count(*) AS transitions, sum(entered) / (count(*) * 6.0::DOUBLE) AS churn_per_hour, sum(entered) / sum(members)::DOUBLE AS turnover,
 (SELECT count(DISTINCT entity) FROM tp) AS unique_selected FROM c""", "churn_per_hour turnover")
def _(c):
    top = R.topk(c.tape, "p1", 20)
    per = R.topk_churn(top, 1)
    uniq = top.agg(F.count_distinct("entity"))
    return per.agg(F.sum("entered").alias("entries"), F.count("*").alias("transitions"),
                   (F.sum("entered") / (F.count("*") * 6.0)).alias("churn_per_hour"),
                   (F.sum("entered") / F.sum("members")).alias("turnover")).withColumn("unique_selected", uniq.scalar())


RANKS = f"rr AS (SELECT *, {rk('p1', 'rank1')}, {rk('p2', 'rank2')} FROM scores)"


def ranks(c):
    return R.risk_rank(R.risk_rank(c.tape, "p1", name="rank1"), "p2", name="rank2")


@plan("candidate_union", "J21", ("scores",), RANKS + " SELECT bin, count(*) AS candidates, sum(label)::BIGINT AS positives FROM rr WHERE rank2 <= 30 OR rank1 <= 10 GROUP BY 1")
def _(c):
    return R.candidate_union(ranks(c), 30, 10).groupBy("bin").agg(F.count("*").alias("candidates"), F.sum("label").alias("positives"))


@plan("candidate_ceiling", "E15 J20", ("scores",), RANKS + """, g AS (SELECT * FROM (VALUES (20, 5), (30, 10), (40, 20)) v(m, n)),
p AS (SELECT m, n, bin, sum(CASE WHEN rank2 <= m OR rank1 <= n THEN label ELSE 0 END) AS u, sum(label) AS p FROM rr, g GROUP BY 1, 2, 3)
SELECT m::BIGINT AS m, n::BIGINT AS n, sum(least(u, 20))::BIGINT AS reachable, sum(least(p, 20))::BIGINT AS best, sum(u)::BIGINT AS covered, sum(u) / sum(p)::DOUBLE AS share FROM p GROUP BY 1, 2""", "share")
def _(c):
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in ((20, 5), (30, 10), (40, 20))]))
    r = ranks(c).withColumn("g", grid).select("bin", "label", "rank1", "rank2", "g.*")
    per = r.groupBy("m", "n", "bin").agg(F.sum(F.when((F.col("rank2") <= F.col("m")) | (F.col("rank1") <= F.col("n")), F.col("label")).otherwise(0)).alias("u"), F.sum("label").alias("p"))
    return per.groupBy("m", "n").agg(F.sum(F.least("u", F.lit(20))).alias("reachable"), F.sum(F.least("p", F.lit(20))).alias("best"),
                                     F.sum("u").alias("covered"), (F.sum("u") / F.sum("p")).alias("share"))


@plan("swap_tail", "K3 K4", ("scores",), RANKS + """, c AS (SELECT bin, entity AS ne, p1 AS rn, row_number() OVER (PARTITION BY bin ORDER BY p1 DESC, entity) AS i FROM rr
  WHERE (rank2 <= 60 OR rank1 <= 40) AND rank2 > 20 AND rank1 < rank2),
s AS (SELECT bin, 21 - rank2 AS i, entity AS oe, p1 AS ro, rank2 AS slot FROM rr WHERE rank2 <= 20 AND rank2 > 15),
h AS (SELECT * FROM (SELECT bin, ne, oe, slot, min((rn >= 1.2 * ro)::INT) OVER (PARTITION BY bin ORDER BY i) AS ok FROM c JOIN s USING (bin, i) WHERE i <= 5) WHERE ok = 1),
z AS (SELECT rr.entity, rr.bin, rr.rank2, CASE WHEN a.ne IS NOT NULL THEN true WHEN b.oe IS NOT NULL THEN false ELSE rank2 <= 20 END AS in_top, coalesce(a.slot, rank2) AS pos
 FROM rr LEFT JOIN h a ON a.bin = rr.bin AND a.ne = rr.entity LEFT JOIN h b ON b.bin = rr.bin AND b.oe = rr.entity)
SELECT entity, bin, in_top, row_number() OVER (PARTITION BY bin ORDER BY in_top DESC, pos) AS position FROM z""")
def _(c):
    return R.swap_tail(ranks(c), 20, 60, 40, 5, 1.2, "p1").select("entity", "bin", "in_top", "position")


def ap_sql(group, score="p1", src="scores"):
    g = ", ".join(group)
    part = f"PARTITION BY {g}" if group else ""
    gb = f"GROUP BY {g}" if group else ""
    sel = f"{g}, " if group else ""
    return f"""hist AS (SELECT {sel}{score} AS s, sum(label) AS pos, count(*) AS n FROM {src} GROUP BY {sel}s),
cum AS (SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(n) OVER ({part} ORDER BY s DESC) AS seen FROM hist),
q AS (SELECT {sel}sum(n)::BIGINT AS rows, sum(pos)::BIGINT AS positives, CASE WHEN sum(pos) > 0 THEN sum(pos * tp / seen::DOUBLE) / sum(pos) ELSE 0.0::DOUBLE END AS ap,
 CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)) END AS auc FROM cum {gb})
"""


@plan("ap_auc_pooled", "E1 E2 D5", ("scores",), ap_sql([]) + "SELECT * FROM q", "ap auc")
def _(c):
    return M.ranking_quality(c.tape, [], "p1", "label")


@plan("ap_auc_by_origin", "E1 E2 E9", ("scores",), ap_sql(["origin"], "p2") + "SELECT * FROM q", "ap auc")
def _(c):
    return M.ranking_quality(c.tape, ["origin"], "p2", "label")


@plan("origin_macro", "E9 A38", ("scores",), ap_sql(["origin"]) + """SELECT count(*) AS origins, avg(ap) AS mean_ap, stddev_pop(ap) AS std_ap, min(ap) AS min_ap, max(ap) AS max_ap,
 avg(ap / (positives / rows::DOUBLE)) AS mean_ap_ratio FROM q WHERE positives > 0""", "mean_ap std_ap min_ap max_ap mean_ap_ratio")
def _(c):
    q = M.ranking_quality(c.tape, ["origin"], "p1", "label").where(F.col("positives") > 0)
    return q.agg(F.count("*").alias("origins"), F.avg("ap").alias("mean_ap"), F.stddev_pop("ap").alias("std_ap"), F.min("ap").alias("min_ap"),
                 F.max("ap").alias("max_ap"), F.avg(F.col("ap") / (F.col("positives") / F.col("rows"))).alias("mean_ap_ratio"))


@plan("mean_time_ap", "E26", ("scores",), ap_sql(["origin", "bin"]) + "SELECT origin, avg(ap) AS mean_ap, avg(positives / rows::DOUBLE) AS mean_prevalence FROM q GROUP BY 1", "mean_ap mean_prevalence")
def _(c):
    return M.mean_time_ap(c.tape, ["bin"], ["origin"], "p1", "label")


@plan("prob_losses", "E3", ("scores",), """c AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p1)) AS q FROM scores)
SELECT origin, avg((p1 - label) * (p1 - label)) AS brier, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss, avg(p1) AS mean_prediction, avg(label) AS prevalence FROM c GROUP BY 1""",
      "brier log_loss mean_prediction prevalence")
def _(c):
    return M.prob_losses(c.scores, ["origin"], "p1", "label")


@plan("calibration_error", "E4", ("scores",), """b AS (SELECT origin, least(floor(p1 * 10), 9) AS b, count(*) AS n, avg(p1) AS mp, avg(label) AS my FROM scores GROUP BY 1, 2)
SELECT origin, sum(n * abs(mp - my)) / sum(n) AS ece FROM b GROUP BY 1""", "ece")
def _(c):
    return M.calibration_error(c.scores, ["origin"], "p1", "label")


def atk_sql(score, group):
    g = "".join(f"{x}, " for x in group)
    return f"""rk AS (SELECT *, {rk(score)} FROM scores), ks AS (SELECT * FROM (VALUES (10), (20), (50)) v(k)),
idl AS (SELECT k, p, sum(1 / log2(i + 1)) AS ideal FROM ks, (SELECT unnest(range(1, 51)) AS p), (SELECT unnest(range(1, 51)) AS i) WHERE i <= least(p, k) GROUP BY 1, 2),
per AS (SELECT {g}bin, ks.k AS k, count(*) AS n, sum(label) AS pos, sum(CASE WHEN rank <= ks.k THEN label ELSE 0 END) AS hits,
 sum(CASE WHEN rank <= ks.k AND label = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM rk, ks GROUP BY ALL),
atk AS (SELECT {g}per.k::BIGINT AS k, sum(hits)::BIGINT AS hits, sum(pos)::BIGINT AS positives, count(*) AS times, sum(hits) / greatest(sum(pos), 1)::DOUBLE AS recall,
 sum(hits) / (count(*) * per.k)::DOUBLE AS precision, sum(hits) / (count(*) * per.k)::DOUBLE / (sum(pos) / sum(n)::DOUBLE) AS lift,
 avg(CASE WHEN pos > 0 THEN hits / pos::DOUBLE END) AS macro_recall, avg(CASE WHEN pos > 0 THEN dcg / ideal END) AS ndcg
 FROM per LEFT JOIN idl ON idl.k = per.k AND idl.p = least(per.pos, 50) GROUP BY {g}per.k)
"""


ATK = "recall precision lift macro_recall ndcg"


@plan("recall_ndcg_at_k", "E5 E6 E7 F25", ("scores",), atk_sql("p1", []) + "SELECT * FROM atk", ATK)
def _(c):
    return M.at_k(c.tape, "p1", [10, 20, 50], ["bin"], [])


@plan("fold_metrics", "E19 E5 E7", ("scores",), atk_sql("p2", ["origin"]) + "SELECT * FROM atk", ATK)
def _(c):
    return M.at_k(c.tape, "p2", [10, 20, 50], ["bin"], ["origin"])


@plan("fraction_capture", "E8 K2", ("scores",), f"""rk AS (SELECT *, {rk()}, count(*) OVER (PARTITION BY bin) AS n FROM scores), f AS (SELECT * FROM (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) v(fraction)),
p AS (SELECT fraction, bin, max(greatest(1, ceil(n * fraction))) AS k, sum(label) AS pos, sum(CASE WHEN rank <= greatest(1, ceil(n * fraction)) THEN label ELSE 0 END) AS hits FROM rk, f GROUP BY 1, 2)
SELECT fraction, sum(hits)::BIGINT AS hits, sum(hits) / sum(pos)::DOUBLE AS capture, sum(hits) / sum(k)::DOUBLE AS precision, avg(CASE WHEN pos > 0 THEN hits / pos::DOUBLE END) AS macro_recall,
 avg(CASE WHEN pos > 0 THEN hits / k::DOUBLE END) AS macro_precision FROM p GROUP BY 1""", "fraction capture precision macro_recall macro_precision")
def _(c):
    return M.fraction_metrics(c.tape, "p1", [0.02, 0.05], ["bin"])


@plan("best_f1", "E11", ("scores",), ap_sql(["origin"]) + """, t AS (SELECT origin, sum(pos) AS p FROM hist GROUP BY 1), f AS (SELECT origin, s, 2 * tp / (seen + p)::DOUBLE AS f1 FROM cum JOIN t USING (origin))
SELECT origin, s AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY f1 DESC, s DESC) AS r FROM f) WHERE r = 1""", "threshold f1")
def _(c):
    return M.best_f1(c.tape, ["origin"], "p1", "label")


@plan("at_threshold", "E11", ("scores",), """SELECT origin, count(*) FILTER (WHERE p1 >= 0.8 AND label = 1) AS tp, count(*) FILTER (WHERE p1 >= 0.8) AS alerts, count(*) FILTER (WHERE label = 1) AS pos,
 coalesce(count(*) FILTER (WHERE p1 >= 0.8 AND label = 1) / nullif(count(*) FILTER (WHERE p1 >= 0.8), 0)::DOUBLE, 0) AS precision,
 coalesce(count(*) FILTER (WHERE p1 >= 0.8 AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE, 0) AS recall,
 2 * count(*) FILTER (WHERE p1 >= 0.8 AND label = 1) / greatest(count(*) FILTER (WHERE p1 >= 0.8) + count(*) FILTER (WHERE label = 1), 1)::DOUBLE AS f1 FROM scores GROUP BY 1""", "precision recall f1")
def _(c):
    return M.at_threshold(c.scores, ["origin"], "p1", "label", F.lit(0.8))


CAP = f"""tp AS (SELECT entity, t FROM (SELECT *, {rk()} FROM scores) WHERE rank <= 20), ax AS (SELECT DISTINCT t FROM scores), sp AS (SELECT min(t) AS a, max(t) AS b FROM ax),
gr AS (SELECT unnest(range(a, b + 1, 6*{H})) AS t FROM sp), du AS (SELECT DISTINCT t - {D} AS lo, t - 600000000 AS hi FROM faults),
el AS (SELECT lo, lo >= a AND hi <= b AND (SELECT count(*) FROM gr WHERE gr.t BETWEEN lo AND hi) > 0 AND (SELECT count(*) FROM gr WHERE gr.t BETWEEN lo AND hi AND gr.t NOT IN (SELECT t FROM ax)) = 0 AS ok FROM du, sp),
cap AS (SELECT o.entity, o.onset_t, any_value(el.ok) AS eligible, count(tp.t) > 0 AS captured, count(tp.t) AS alerts,
 (o.onset_t - min(tp.t)) / {H}.0::DOUBLE AS lead_hours FROM (SELECT DISTINCT entity, t AS onset_t FROM faults) o JOIN el ON el.lo = o.onset_t - {D}
 LEFT JOIN tp ON tp.entity = o.entity AND tp.t >= o.onset_t - {D} AND tp.t <= o.onset_t - 600000000 GROUP BY 1, 2)
"""


def capture(c, times):
    return M.onset_capture(R.topk(c.scores, "p1", 20), times, c.faults, DAY, 600_000_000, 6 * HOUR)


@plan("onset_capture", "E12 J18", ("scores", "faults"), CAP + "SELECT * FROM cap", "lead_hours")
def _(c):
    """Every decision time is used."""
    return capture(c, c.decisions)


SUMMARY = """SELECT count(*) AS onsets, count(*) FILTER (WHERE captured) AS captured, avg(captured::INT) AS rate, quantile_cont(lead_hours, 0.1) AS lead_p10,
 quantile_cont(lead_hours, 0.5) AS lead_median, quantile_cont(lead_hours, 0.9) AS lead_p90 FROM cap WHERE eligible"""
LEADS = "rate lead_p10 lead_median lead_p90"


@plan("capture_summary", "E12", ("scores", "faults"), CAP + SUMMARY, LEADS)
def _(c):
    return M.capture_summary(materialize(capture(c, c.decisions), "capture"))


@plan("episode_capture", "E13", ("scores", "faults"), f"""rk AS (SELECT *, {rk()}, count(*) OVER (PARTITION BY bin) AS n FROM scores),
a AS (SELECT r.entity, r.t, r.rank, r.n, min(f.t) AS onset_t, arg_min(f.code, f.t) AS code FROM rk r JOIN faults f ON f.entity = r.entity AND f.t > r.t AND f.t <= r.t + {D} GROUP BY 1, 2, 3, 4),
e AS (SELECT entity, code, onset_t, max((rank <= 20)::INT) AS hit, 1 - exp(sum(CASE WHEN n > 20 THEN ln(1 - 20.0 / n) ELSE -1e9 END)) AS random, min(CASE WHEN rank <= 20 THEN t END) AS ft FROM a GROUP BY 1, 2, 3)
SELECT code, count(*) AS episodes, sum(hit)::BIGINT AS captured, avg(hit) AS rate, avg(random) AS random_rate, median((onset_t - ft) / {H}.0::DOUBLE) AS median_lead_hours FROM e GROUP BY 1""",
      "rate random_rate median_lead_hours")
def _(c):
    sizes = c.decisions.groupBy("bin").agg(F.count("*").alias("n"))
    rows = R.risk_rank(c.tape, "p1").join(sizes, "bin").select("entity", "t", "rank", "n")
    return M.episode_capture(rows, c.faults, 20, DAY)


@plan("population_table", "E17", ("scores",), """b AS (SELECT origin, count(*) AS n, sum(label) AS p FROM scores GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, sum(p)::BIGINT AS positives, sum(p) / sum(n)::DOUBLE AS prevalence, count(*) AS blocks, count(*) FILTER (WHERE p > 0 AND p < n) AS two_class_blocks FROM b""", "prevalence")
def _(c):
    return M.population_table(c.scores, "origin", [])


@plan("split_metrics", "E16", ("scores",), f"sx AS (SELECT *, unnest([CASE WHEN bin < {at(2, 3, 'scores')} THEN 'development' ELSE 'terminal' END, 'full']) AS split FROM scores), " + ap_sql(["split"], "p1", "sx") + "SELECT * FROM q", "ap auc")
def _(c):
    return M.ranking_quality(M.split_rows(c.tape, c.at(2, 3)), ["split"], "p1", "label")


@plan("model_metrics", "E28 E25", ("scores",), "sx AS (UNPIVOT (SELECT origin, label, p1, p2 FROM scores) ON p1, p2 INTO NAME model VALUE score), " + ap_sql(["model", "origin"], "score", "sx") + "SELECT * FROM q", "ap auc")
def _(c):
    long = M.unpivot_models(c.tape, ["entity", "origin", "label"], ["p1", "p2"])
    return M.ranking_quality(long, ["model", "origin"], "score", "label")


@plan("model_comparison", "E27 A40", ("scores",), "sx AS (UNPIVOT (SELECT origin, label, p1, p2 FROM scores) ON p1, p2 INTO NAME model VALUE score), " + ap_sql(["model", "origin"], "score", "sx") + """, j AS (SELECT a.ap, a.ap - b.ap AS d FROM q a JOIN q b ON a.origin = b.origin AND a.model = 'p2' AND b.model = 'p1')
SELECT 'p2' AS model, avg(ap) AS mean, avg(d) AS mean_delta, median(d) AS median_delta, count(*) FILTER (WHERE d > 1e-12) AS wins, count(*) FILTER (WHERE abs(d) <= 1e-12) AS ties,
 count(*) FILTER (WHERE d < -1e-12) AS losses, min(d) AS worst_delta FROM j""", "mean mean_delta median_delta worst_delta")
def _(c):
    long = M.unpivot_models(c.tape, ["entity", "origin", "label"], ["p1", "p2"])
    return M.compare_summary(M.ranking_quality(long, ["model", "origin"], "score", "label"), "p1", ["origin"], "ap")


@plan("random_reference", "E21", ("scores",), """SELECT bin, 10 / n AS recall, 1 - pow(1 - 10 / n, 287) AS capture, 10 * (1 - 10 / n) * 12 AS churn_per_hour FROM (SELECT bin, count(*)::DOUBLE AS n FROM scores GROUP BY 1)""", "recall capture churn_per_hour")
def _(c):
    n = c.decisions.groupBy("bin").agg(F.count("*").alias("n"))
    return n.select("bin", *M.random_reference(F.col("n"), 10))


@plan("cohort_compare", "E20 P25", ("scores",), "sx AS (SELECT *, CASE WHEN k = 0 THEN 'clean' ELSE 'repeat' END AS cohort FROM scores), " + ap_sql(["cohort"], "p1", "sx") + "SELECT * FROM q", "ap auc")
def _(c):
    d = c.tape.withColumn("cohort", F.when(F.col("k") == 0, "clean").otherwise("repeat"))
    return M.ranking_quality(d, ["cohort"], "p1", "label")


# ---- scalar functions and fusion -------------------------------------------------

SC = ("lgt sgm restored nat pareto report fused blend napp recency ratio eps dis")


@plan("score_functions", "F4 F5 F6 F7 F8 F9 F10 F11 F12 F16 F17 F21 F25 J17", ("scores",), f"""SELECT entity, bin, ln(p1 / (1 - p1)) AS lgt, 1 / (1 + exp(-(p1 * 4 - 2))) AS sgm,
 (p1/(1-p1) * (0.1/0.9::DOUBLE) / (0.3/0.7::DOUBLE)) / (1 + p1/(1-p1) * (0.1/0.9::DOUBLE) / (0.3/0.7::DOUBLE)) AS restored,
 1 / (1 + exp(-(ln(p1/(1-p1)) + ln(0.1/0.9::DOUBLE)))) AS nat, least(1.0, greatest(0.05, least(0.6, pow(1.0 / (k + 1), 1.2)))) AS pareto,
 0.2 + 0.4 * (1.0 / (k + 1)) AS report, 0.6 * p1 + 0.4 * p2 AS fused, (ln(p1/(1-p1)) + 2 * p2) / 3 AS blend, greatest(0.0, least(1.0, (p1 - 0.3) / 0.7)) AS napp,
 exp(-ln(2) * bin / 40) AS recency, CASE WHEN abs(p2 - 0.5) > 1e-4 THEN greatest(-100.0, least(100.0, p1 / (p2 - 0.5))) ELSE 0.0 END AS ratio, p1 / (p2 + 1e-4) AS eps, 1 / log2(k + 2) AS dis FROM scores""", SC)
def _(c):
    p1 = F.col("p1")
    return c.scores.select(
        "entity", "bin", S.logit("p1").alias("lgt"), S.expit(p1 * 4 - 2).alias("sgm"), S.restore_prior("p1", F.lit(0.1), F.lit(0.3)).alias("restored"),
        S.natural_probability("p1", F.lit(0.1)).alias("nat"), S.pareto_weight("k", 1.2).alias("pareto"), S.report_weight("k", 0.6, 0.2).alias("report"),
        S.fuse("p1", "p2", 0.6).alias("fused"), S.inertia_blend(S.logit("p1"), "p2", 2.0).alias("blend"), S.norm_ap("p1", F.lit(0.3)).alias("napp"),
        S.recency_weight("bin", 40).alias("recency"), S.safe_ratio(p1, F.col("p2") - 0.5).alias("ratio"), S.eps_ratio("p1", "p2").alias("eps"),
        S.dcg_discount(F.col("k") + 1).alias("dis"))


@plan("calendar_keys", "F2 F3 F1", ("faults",), f"""SELECT event_id, (t // {H}) % 24 AS hour, (t // {D} + 3) % 7 AS dow, ((t // {D} + 3) % 7 >= 5)::BIGINT AS weekend,
 (t + 9*{H}) // {D} AS local_day, strftime(make_timestamp(t + 9*{H}), '%Y-%m-%d') AS day_key, strftime(make_timestamp(t + 9*{H}), '%Y-%m-%d') || '-' || CASE WHEN ((t + 9*{H}) // {H}) % 24 < 12 THEN 'AM' ELSE 'PM' END AS half_day_key FROM faults""")
def _(c):
    return c.faults.select("event_id", S.hour_of_day("t").alias("hour"), S.day_of_week("t").alias("dow"), S.is_weekend("t").alias("weekend"),
                           S.local_day("t").alias("local_day"), S.day_key("t").alias("day_key"), S.half_day_key("t").alias("half_day_key"))


@plan("string_functions", "P1 P2 F22 F23 P8", ("faults",), """SELECT event_id, 'node-' || grp AS node, slot, '10.140.' || (grp // 4) || '.' || grp AS address, 'xid' || code || '_' || entity || '_e' || event_id AS label,
 CASE WHEN code % 3 = 0 THEN NULL ELSE '10.140.1.2' END AS maybe_address, CASE WHEN slot * 10 < 10 THEN 'idle' WHEN slot * 10 < 50 THEN 'low' ELSE 'high' END AS activity,
 '{"code":' || code || ',"slot":' || slot || '}' AS payload FROM faults""")
def _(c):
    ident = F.format_string("node-%d-%d", "grp", "slot")
    raw = F.format_string("SH-IDC1-10-140-%d-%d", S.idiv("grp", 4), F.col("grp"))
    maybe = F.when(F.col("code") % 3 == 0, "no address").otherwise("x-10-140-1-2")
    return c.faults.select(
        "event_id", S.entity_group(ident).alias("node"), S.entity_slot(ident).alias("slot"), S.normalize_node(raw).alias("address"),
        S.event_label("code", "entity", "event_id").alias("label"), S.normalize_node(maybe).alias("maybe_address"),
        S.activity_state((F.col("slot") * 10).cast("double")).alias("activity"), F.to_json(F.struct("code", "slot")).alias("payload"))


@plan("pareto_alpha", "A42", ("faults", "ents"), """k AS (SELECT e.entity, count(f.t) FILTER (WHERE f.code = 43 AND f.slot % 3 = 0) AS k FROM ents e LEFT JOIN faults f USING (entity) GROUP BY 1)
SELECT CASE WHEN count(*) FILTER (WHERE k > 0) < 5 THEN 1.0 ELSE count(*) FILTER (WHERE k > 0) / sum(CASE WHEN k > 0 THEN ln(k + 1) END) END AS alpha, count(*) FILTER (WHERE k > 0) AS entities FROM k""", "alpha")
def _(c):
    k = c.telemetry.groupBy("entity").agg(F.count_if((F.col("event_type") == "error") & (F.pmod("temp", F.lit(2.0)) == 1) & (F.col("slot") % 3 == 0)).alias("k"))
    return U.pareto_alpha(k)


FUS = "fu AS (SELECT *, least(0.6, 1.0 / (k + 1)) * p1 + (1 - least(0.6, 1.0 / (k + 1))) * p2 AS fused FROM scores)"


@plan("weighted_fusion", "F9 F11", ("scores",), FUS + " SELECT entity, bin, fused FROM fu", "fused")
def _(c):
    return U.weighted_fusion(c.scores).select("entity", "bin", "fused")


@plan("weight_sweep", "M27 J20", ("scores",), "g AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(alpha)), sx AS (SELECT alpha, label, least(0.6, pow(1.0 / (k + 1), alpha)) * p1 + (1 - least(0.6, pow(1.0 / (k + 1), alpha))) * p2 AS f FROM scores, g), "
      + ap_sql(["alpha"], "round(f, 9)", "sx") + "SELECT * FROM q", "alpha ap auc")
def _(c):
    g = F.explode(F.array(*[F.lit(a) for a in (0.5, 1.0, 2.0)]))
    d = U.weighted_fusion(c.tape.withColumn("alpha", g), F.col("alpha")).withColumn("f", F.round("fused", 9))
    return M.ranking_quality(d, ["alpha"], "f", "label")


def ema_sql(hl):
    return f"""z AS (SELECT entity, bin, t, ln(p1 / (1 - p1)) AS z, p1, p2, row_number() OVER (PARTITION BY entity ORDER BY bin) AS r FROM scores),
e AS (SELECT entity, bin, t, r, z, CAST(NULL AS DOUBLE) AS mem, z AS state FROM z WHERE r = 1
 UNION ALL SELECT z.entity, z.bin, z.t, z.r, z.z, e.state, pow(2.0, -(z.t - e.t) / ({hl} * {H}.0)) * e.state + (1 - pow(2.0, -(z.t - e.t) / ({hl} * {H}.0))) * z.z FROM e JOIN z ON z.entity = e.entity AND z.r = e.r + 1)
"""


@plan("ema_memory", "W20 W21 D2", ("scores",), ema_sql(12) + "SELECT entity, bin, mem AS memory FROM e", "memory")
def _(c):
    d = c.tape.withColumn("z", S.logit("p1"))
    return U.ema_memory(d, ["entity"], "t", "z", 12.0, chunk_half_lives=12).select("entity", "bin", "memory")


@plan("inertia_scores", "W20 F12", ("scores",), ema_sql(2) + "SELECT entity, bin, 1 / (1 + exp(-CASE WHEN mem IS NULL THEN z ELSE (z + 1.0 * mem) / 2.0 END)) AS q FROM e", "q")
def _(c):
    return U.inertia(c.tape, "t", "p1", 2.0, 1.0).select("entity", "bin", "q")


@plan("inertia_with_reset", "W21", ("scores",), f"""z AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS r FROM (SELECT entity, bin, t, ln(p1 / (1 - p1)) AS z FROM scores WHERE (bin // 7) % 4 <> 1)),
e AS (SELECT entity, bin, t, r, z, CAST(NULL AS DOUBLE) AS mem, z AS state FROM z WHERE r = 1
 UNION ALL SELECT z.entity, z.bin, z.t, z.r, z.z, CASE WHEN z.t - e.t >= {D} THEN NULL ELSE e.state END,
 CASE WHEN z.t - e.t >= {D} THEN z.z ELSE pow(2.0, -(z.t - e.t) / (6 * {H}.0)) * e.state + (1 - pow(2.0, -(z.t - e.t) / (6 * {H}.0))) * z.z END FROM e JOIN z ON z.entity = e.entity AND z.r = e.r + 1)
SELECT entity, bin, mem AS memory FROM e""", "memory")
def _(c):
    d = c.decisions.where(S.idiv("bin", 7) % 4 != 1)
    s1 = F.pmod(F.col("entity") * 37 + F.col("bin") * 101 + F.col("entity") * F.col("bin"), F.lit(997))
    d = d.withColumn("z", S.logit((s1 + F.lit(0.5)) / 997))
    return U.ema_memory(d, ["entity"], "t", "z", 6.0, reset_us=DAY).select("entity", "bin", "memory")


@plan("dual_memory", "W22 F13", ("scores",), ema_sql(2).replace("z AS (", "z AS (", 1) + f""", y AS (SELECT entity, bin, t, ln(p2 / (1 - p2)) AS z, row_number() OVER (PARTITION BY entity ORDER BY bin) AS r FROM scores),
e2 AS (SELECT entity, bin, t, r, z, CAST(NULL AS DOUBLE) AS mem, z AS state FROM y WHERE r = 1
 UNION ALL SELECT y.entity, y.bin, y.t, y.r, y.z, e2.state, pow(2.0, -(y.t - e2.t) / (6 * {H}.0)) * e2.state + (1 - pow(2.0, -(y.t - e2.t) / (6 * {H}.0))) * y.z FROM e2 JOIN y ON y.entity = e2.entity AND y.r = e2.r + 1)
SELECT e.entity, e.bin, e.mem / 6 AS m1, e2.mem / 6 AS m2, (e.z / 6) * (e2.z / 6) AS b12, (e.z / 6) * (e.mem / 6) AS z1m1 FROM e JOIN e2 USING (entity, bin)""", "m1 m2 b12 z1m1")
def _(c):
    d = c.tape.select("entity", "bin", "t", "p1", "p2", S.logit("p1").alias("z1"), S.logit("p2").alias("z2"))
    d = U.ema_memory(d, ["entity"], "t", "z1", 2.0, name="mem1")
    d = U.ema_memory(d, ["entity"], "t", "z2", 6.0, name="mem2")
    b = S.residual_basis("p1", "p2", "mem1", "mem2")
    return d.select("entity", "bin", b["m1"].alias("m1"), b["m2"].alias("m2"), b["b12"].alias("b12"), b["z1m1"].alias("z1m1"))


@plan("held_scores", "P23 E18", ("scores",), f"""c AS (SELECT entity, bin, p1 FROM scores WHERE bin % 6 = 0) SELECT s.entity, s.bin, c.p1 AS held FROM scores s LEFT JOIN c ON c.entity = s.entity AND c.bin = s.bin // 6 * 6""", "held")
def _(c):
    s = c.scores
    h = U.hold_scores(s.where(F.col("bin") % 6 == 0).select("entity", "t", F.col("p1").alias("held")), c.decisions.select("entity", "bin", "t"), score="held")
    return h.select("entity", "bin", "held")


@plan("cadence_comparison", "E18 P21 P22 P23", ("scores",), f"""c AS (SELECT entity, bin, p1 FROM scores WHERE bin % 6 = 0), h AS (SELECT s.entity, s.bin, s.label, s.p1, c.p1 AS held FROM scores s JOIN c ON c.entity = s.entity AND c.bin = s.bin // 6 * 6),
v AS (SELECT 'fine' AS variant, bin, entity, label, p1 AS score FROM h UNION ALL SELECT 'held', bin, entity, label, held FROM h UNION ALL SELECT 'coarse', bin, entity, label, p1 FROM h WHERE bin % 6 = 0 UNION ALL SELECT 'extra', bin, entity, label, p1 FROM h WHERE bin % 6 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, bin ORDER BY score DESC, entity) AS rank FROM v)
SELECT variant, count(DISTINCT bin) AS times, sum(label)::BIGINT AS positives, sum(CASE WHEN rank <= 20 THEN label ELSE 0 END)::BIGINT AS hits FROM r GROUP BY 1""")
def _(c):
    s = c.tape
    h = U.hold_scores(s.where(F.col("bin") % 6 == 0).select("entity", "t", F.col("p1").alias("held")), s.select("entity", "bin", "t", "label", "p1"), score="held")
    coarse = F.col("bin") % 6 == 0
    v = F.array(F.struct(F.lit("fine").alias("variant"), F.col("p1").alias("score")), F.struct(F.lit("held").alias("variant"), F.col("held").alias("score")),
                F.struct(F.when(coarse, "coarse").otherwise("extra").alias("variant"), F.col("p1").alias("score")))
    d = h.withColumn("v", F.explode(v)).select("entity", "bin", "label", "v.*")
    per = M.per_time_at_k(d, "score", [20], ["bin", "variant"])
    return per.groupBy("variant").agg(F.count("*").alias("times"), F.sum("pos").alias("positives"), F.sum("hits_20").alias("hits"))


@plan("warning_rows", "J18", ("scores", "faults"), f"""SELECT f.event_id, count(*) AS rows, max(s.p1) AS top FROM faults f JOIN scores s ON s.entity = f.entity AND s.t >= f.t - {D} AND s.t < f.t GROUP BY 1""", "top")
def _(c):
    from ..operators.joins import interval_join
    iv = c.faults.select("entity", "event_id", (F.col("t") - DAY).alias("lo"), F.col("t").alias("hi"))
    j = interval_join(c.tape.select("entity", "t", "p1"), iv, ["entity"], "t", "lo", "hi", DAY)
    return j.groupBy("event_id").agg(F.count("*").alias("rows"), F.max("p1").alias("top"))
