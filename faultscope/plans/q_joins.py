"""Time-aware joins, labels, gates and schedules."""

from pyspark.sql import functions as F

from ..canonical import T0
from ..functions.scalar import DAY, HOUR, bin_index, idiv
from ..operators import joins as J
from ..operators import labels as L
from ..session import materialize
from .oracle import D, H, STEP, at
from .q_episodes import LEDGER, ledger
from .registry import plan

HR = HOUR


def dec(c):
    return c.decisions.select("entity", "grp", "bin", "t")


@plan("asof_last_onset", "J6", ("decisions", "faults"), """SELECT d.entity, d.bin, coalesce(max(f.t), -1) AS last_t FROM decisions d
 LEFT JOIN faults f ON f.entity = d.entity AND f.t <= d.t - 600000000 GROUP BY 1, 2""")
def _(c):
    d = J.asof(dec(c), c.faults, ["entity"], F.col("t") - 600_000_000, "t", {"last_t": "t"}, width=3 * DAY, until=c.bounds[1])
    return d.select("entity", "bin", F.coalesce("last_t", F.lit(-1)).alias("last_t"))


@plan("asof_next_onset", "J7", ("decisions", "faults"), """SELECT d.entity, d.bin, coalesce(min(f.t), -1) AS next_t FROM decisions d
 LEFT JOIN faults f ON f.entity = d.entity AND f.t > d.t GROUP BY 1, 2""")
def _(c):
    return L.next_event(dec(c), c.faults, name="n", bounds=c.bounds).select("entity", "bin", F.coalesce("n", F.lit(-1)).alias("next_t"))


@plan("label_future", "J8", ("scores",), "SELECT entity, bin, label FROM scores")
def _(c):
    return L.label_future(dec(c), c.faults, bounds=c.bounds).select("entity", "bin", "label")


@plan("label_bins_inclusive", "J9 P28", ("decisions", "faults"), f"""p AS (SELECT DISTINCT entity, unnest(range((t - {T0}) // {STEP} - 4, (t - {T0}) // {STEP} + 1)) AS bin FROM faults)
SELECT d.entity, d.bin, (p.bin IS NOT NULL)::BIGINT AS label FROM decisions d LEFT JOIN p ON p.entity = d.entity AND p.bin = d.bin""")
def _(c):
    ob = c.faults.select("entity", bin_index("t", T0, 6 * HR).alias("bin"))
    return L.label_bins(dec(c), ob, 4).select("entity", "bin", "label")


STATE = LEDGER + f""", st AS (SELECT d.entity, d.bin, d.t, (count(*) FILTER (WHERE NOT l.uncertain_onset AND l.onset_t > d.t AND l.onset_t <= d.t + {D}) > 0)::BIGINT AS label,
 count(*) FILTER (WHERE l.uncertain_onset AND l.onset_t > d.t AND l.onset_t <= d.t + {D}) AS u, max(l.onset_t) FILTER (WHERE l.onset_t <= d.t) AS lo,
 arg_max(l.end_t, l.onset_t) FILTER (WHERE l.onset_t <= d.t) AS le FROM decisions d LEFT JOIN ledger l ON l.entity = d.entity GROUP BY 1, 2, 3)
"""


@plan("label_state", "L2 J8 J10", ("flog", "decisions"), STATE + "SELECT entity, bin, label, NOT coalesce(le >= t, false) AND u = 0 AS eligible FROM st")
def _(c):
    led = materialize(ledger(c), "ledger")
    return L.label_state(dec(c), led, bounds=c.bounds).select("entity", "bin", "label", "eligible")


@plan("label_state_code", "L3", ("flog", "decisions"), STATE.replace("ON l.entity = d.entity", "ON l.entity = d.entity AND l.code = 43") + "SELECT entity, bin, label, NOT coalesce(le >= t, false) AND u = 0 AS eligible FROM st")
def _(c):
    led = materialize(ledger(c), "ledger")
    return L.label_state_for_code(dec(c), led, 43, bounds=c.bounds).select("entity", "bin", "label", "eligible")


@plan("multi_head_labels", "L4 P24", ("decisions", "faults"), f"""SELECT d.entity, d.bin, (count(f.t) > 0)::BIGINT AS label_any,
 (count(f.t) FILTER (WHERE code = 31) > 0)::BIGINT AS label_31, (count(f.t) FILTER (WHERE code = 43) > 0)::BIGINT AS label_43
 FROM decisions d LEFT JOIN faults f ON f.entity = d.entity AND f.t > d.t AND f.t <= d.t + {D} GROUP BY 1, 2""")
def _(c):
    return L.multi_labels(dec(c), c.faults, [31, 43], bounds=c.bounds).select("entity", "bin", "label_any", "label_31", "label_43")


@plan("label_precedence", "L5", ("grid", "scores"), """SELECT s.entity, s.bin, CASE WHEN s.label = 1 THEN 'positive' WHEN g.util_n = 0 THEN 'unknown' ELSE 'negative' END AS state
 FROM scores s JOIN grid g USING (entity, bin)""")
def _(c):
    d = L.label_future(c.grid.withColumn("t", F.lit(T0) + F.col("bin") * F.lit(c.step)), c.faults, bounds=c.bounds)
    return d.select("entity", "bin", L.label3(F.col("label") == 1, F.col("util_n") == 0).alias("state"))


@plan("history_counts", "W11", ("decisions", "faults"), f"""SELECT d.entity, d.bin, {', '.join(f"count(f.t) FILTER (WHERE f.t >= d.t - {s}) AS n_{n}" for n, s in (("6h", 6 * H), ("1d", D), ("7d", 7 * D)))}, count(f.t) AS n_life
 FROM decisions d LEFT JOIN faults f ON f.entity = d.entity AND f.t < d.t GROUP BY 1, 2""")
def _(c):
    d = J.event_counts(dec(c), c.faults, ["entity"], "t", "t", {"n_6h": 6 * HR, "n_1d": DAY, "n_7d": 7 * DAY, "n_life": None},
                       width=5 * DAY, right_inclusive=False, until=c.bounds[1])
    return d.select("entity", "bin", "n_6h", "n_1d", "n_7d", "n_life")


@plan("event_window_join", "J3", ("tel", "faults"), f"""SELECT f.event_id, (t.t - f.t + 6*{H}) // {H} - 6 AS off, sum(t.util) AS util_sum, count(*) AS n
 FROM faults f JOIN tel t ON t.entity = f.entity AND t.t >= f.t - 6*{H} AND t.t < f.t + 6*{H} GROUP BY 1, 2""", "util_sum")
def _(c):
    ev = c.faults.select("entity", "event_id", F.col("t").alias("at"), (F.col("t") - 6 * HR).alias("lo"), (F.col("t") + 6 * HR).alias("hi"))
    j = J.interval_join(c.telemetry.select("entity", "t", "util"), ev, ["entity"], "t", "lo", "hi", width=12 * HR)
    return j.groupBy("event_id", (idiv(F.col("t") - F.col("lo"), HR) - 6).alias("off")).agg(F.sum("util").alias("util_sum"), F.count("*").alias("n"))


BLOCK = f"""iv AS (SELECT entity, t - 12*{H} AS s, t + 6*{H} AS e FROM faults)"""


@plan("blocked_times_removed", "J5 A12", ("decisions", "faults"), BLOCK + """SELECT entity, bin FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.entity = d.entity AND d.t >= iv.s AND d.t <= iv.e)""")
def _(c):
    iv = c.faults.select("entity", (F.col("t") - 12 * HR).alias("s"), (F.col("t") + 6 * HR).alias("e"))
    return J.not_in_intervals(dec(c), iv, ["entity"], "t", "s", "e", until=c.bounds[1]).select("entity", "bin")


GAPS = "gp AS (SELECT p AS gap_start, t AS gap_end FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM tel)) WHERE t - p > 1500000000)"


def gaps(c):
    from ..operators.episodes import recording_gaps
    return materialize(recording_gaps(c.telemetry, "t", 1_500_000_000), "gaps")


@plan("gap_overlap_removed", "J11 P15", ("decisions", "tel"), f"""{GAPS}, m AS (SELECT min(t) AS lo, max(t) AS hi FROM tel)
SELECT entity, bin FROM decisions d, m WHERE d.t >= lo + {D} AND d.t + 6*{H} <= hi AND NOT EXISTS (SELECT 1 FROM gp WHERE d.t < gap_end AND d.t + 6*{H} > gap_start)""")
def _(c):
    b = c.telemetry.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return L.valid_decisions(dec(c), gaps(c), 6 * HR, b.select("lo").scalar(), b.select("hi").scalar(), DAY).select("entity", "bin")


@plan("chrono_split", "P17", ("decisions",), f"""d AS (SELECT t, row_number() OVER (ORDER BY t) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM decisions)),
q AS (SELECT min(CASE WHEN r = floor(n * 0.6) + 1 THEN t END) AS q1, min(CASE WHEN r = floor(n * 0.8) + 1 THEN t END) AS q2 FROM d)
SELECT t, CASE WHEN t <= q1 - 36*{H} THEN 'train' WHEN t >= q1 + 36*{H} AND t <= q2 - 36*{H} THEN 'validation' WHEN t >= q2 + 36*{H} THEN 'test' ELSE 'purged' END AS part FROM d, q""")
def _(c):
    return L.chrono_split(dec(c))


@plan("fold_assignment", "P18", ("decisions",), f"""c AS (SELECT {at(1, 3, 'decisions')} AS a, {at(2, 3, 'decisions')} AS b, {at(5, 6, 'decisions')} AS e)
SELECT CASE WHEN bin >= a AND bin < b THEN 'f1' WHEN bin >= b AND bin < e THEN 'f2' ELSE 'warmup' END AS fold, count(*) AS rows FROM decisions, c GROUP BY 1""")
def _(c):
    a, b, e = (T0 + c.at(*share) * c.step for share in ((1, 3), (2, 3), (5, 6)))
    return L.assign_fold(dec(c), [("f1", a, b), ("f2", b, e)]).groupBy("fold").agg(F.count("*").alias("rows"))


@plan("rolling_origins", "P19 P20", ("bins",), f"""c AS (SELECT {at(1, 3, 'bins')} AS a)
SELECT bin AS origin, least(bin + 4, (SELECT max(bin) + 1 FROM bins)) AS score_end, bin - 6 - 28 AS train_start, bin - 6 AS train_end, true AS mature
 FROM bins, c WHERE bin >= a AND (bin - a) % 4 = 0""")
def _(c):
    o = L.origins(c.binned, "bin", c.at(1, 3) - c.first_last[0], 4)
    return o.join(L.train_intervals(o, 28, 6, 4), "origin")


@plan("origin_assignment", "J19 P27", ("decisions",), f"""c AS (SELECT {at(1, 3, 'decisions')} AS a)
SELECT bin // 4 * 4 AS origin, count(*) AS rows, min(bin) AS first_bin, max(bin) AS last_bin FROM decisions, c WHERE bin >= a GROUP BY 1""")
def _(c):
    d = dec(c).where(F.col("bin") >= c.at(1, 3)).withColumn("origin", idiv("bin", 4) * 4)
    return d.groupBy("origin").agg(F.count("*").alias("rows"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


@plan("schedule_expansion", "P22", ("bins",), "SELECT bin // 6 * 6 AS origin, bin FROM bins")
def _(c):
    sched = c.binned.select((idiv("bin", 6) * 6).alias("bin")).distinct()
    return L.expand_schedule(sched, "bin", 1, c.binned.agg(F.max("bin")).scalar())


@plan("schedule_from_tape", "P26", ("scores",), """SELECT origin, count(DISTINCT bin) AS times, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS rows,
 count(*) = count(DISTINCT bin) * count(DISTINCT entity) AS full_population FROM scores GROUP BY 1""")
def _(c):
    d = dec(c).withColumn("origin", idiv("bin", 4))
    per = d.groupBy("origin", "bin").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("e"))
    return per.groupBy("origin").agg(F.count("*").alias("times"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"),
                                     F.sum("n").alias("rows"), (F.min("n") == F.max("e")).alias("full_population"))


@plan("positive_intervals", "P14 D4", ("tel", "faults"), f"""h AS (SELECT * FROM (VALUES ('12h', 12*{H}), ('24h', 24*{H}), ('72h', 72*{H})) v(horizon, len)),
m AS (SELECT min(t) AS lo FROM tel), k AS (SELECT entity, event_id, 'raw' AS kind, t AS tm FROM faults UNION ALL SELECT entity, event_id, 'early', t - {H} FROM faults)
SELECT entity, event_id, horizon, kind, greatest(lo, tm - len) AS start_t, tm AS end_t FROM k, h, m""")
def _(c):
    lo = c.telemetry.agg(F.min("t")).scalar()
    f = c.faults.withColumn("early", F.col("t") - HR)
    return L.positive_intervals(f, lo, {"12h": 12 * HR, "24h": 24 * HR, "72h": 72 * HR}, {"raw": "t", "early": "early"})


@plan("positive_bins", "A35 L6", ("faults",), f"""SELECT entity, (t - {T0}) // (24*{H}) AS bin, count(*) AS events, string_agg(DISTINCT code::VARCHAR, '+' ORDER BY code::VARCHAR) AS codes,
 bool_or(t % 2 = 0) AS any_shifted FROM faults GROUP BY 1, 2""")
def _(c):
    return L.positive_bins(c.faults, "t", T0, DAY, F.col("t") % 2 == 0)


@plan("offender_gate", "J22 P25", ("scores", "faults"), f"""o AS (SELECT DISTINCT entity FROM faults WHERE code = 43 AND t < {T0} + 3*{D})
SELECT entity, bin, CASE WHEN entity IN (SELECT entity FROM o) THEN p1 ELSE 0.0 END AS p1 FROM scores""", "p1")
def _(c):
    off = c.faults.where((F.col("code") == 43) & (F.col("t") < T0 + 3 * DAY)).select("entity")
    return J.semi_gate(c.scores.select("entity", "bin", "p1"), off, "entity", "p1")


@plan("needed_buckets", "J23 A5", ("scores", "tel"), f"""s AS (SELECT entity, bin FROM scores WHERE (entity * 7 + bin) % 11 = 0),
n AS (SELECT DISTINCT entity, unnest(range(bin - 3, bin + 1)) AS bin FROM s)
SELECT t.entity, (t.t - {T0}) // {STEP} AS bin, stddev_pop(util) AS util_std, count(util) AS util_n FROM tel t JOIN n ON n.entity = t.entity AND n.bin = (t.t - {T0}) // {STEP} GROUP BY 1, 2""", "util_std")
def _(c):
    from ..operators.grid import bin_std
    s = dec(c).where((F.col("entity") * 7 + F.col("bin")) % 11 == 0)
    need = s.select("entity", F.explode(F.sequence(F.col("bin") - 3, F.col("bin"))).alias("bin")).distinct()
    raw = c.telemetry.withColumn("bin", bin_index("t", T0, c.step)).join(need, ["entity", "bin"], "left_semi")
    return bin_std(raw, ["entity"], "t", T0, c.step, "util")


@plan("score_alignment", "J17 S20", ("scores",), "SELECT count(*) AS keys, count(*) FILTER (WHERE bin % 10 = 0) AS only_a, 0::BIGINT AS only_b FROM scores")
def _(c):
    s = c.scores
    a = J.align(s, s.where(F.col("bin") % 10 != 0), ["entity", "bin"], {"a": "p1"}, {"b": "p2"})
    return J.alignment_violations(a)
