"""Window search at every rolling origin, length selection, the hold-or-search control and the training trace."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import DAY, HOUR
from ..operators import control as C
from ..operators.joins import event_counts
from ..session import materialize, scratch_path
from ..training import models as Mo
from ..training import search as Se
from .oracle import at
from .q_ranking import ap_sql
from .q_sampling import hsh
from .registry import plan

PER_DAY, HORIZON, WINDOWS = 4, 4, (1, 6, 24)
LOAD, HISTORY = Se.RateSelector("load", 12), Se.RateSelector("hist", 4)
GRID = Se.Search(PER_DAY)
SLIDING = Se.Search(PER_DAY, lengths=(9, 12, 15))


def feature_rows(c) -> DataFrame:
    """Decisions with counts of onsets (``hist_h``) and readings (``load_h``) of the last h hours."""
    d = c.tape.select("entity", "bin", "t", "label")
    until = c.bounds[1]
    d = event_counts(d, c.faults, ["entity"], "t", "t", {f"hist_{h}": h * HOUR for h in WINDOWS}, right_inclusive=False, until=until)
    d = event_counts(d, c.telemetry, ["entity"], "t", "t", {f"load_{h}": h * HOUR for h in WINDOWS}, right_inclusive=False, until=until)
    return materialize(d.withColumn("eligible", F.col("bin") <= c.first_last[1] - HORIZON), "search-rows")


def origins(c) -> list[int]:
    """Every day from the middle of the recording on."""
    return list(range(-(-c.at(1, 2) // PER_DAY) * PER_DAY, c.first_last[1] + 1, PER_DAY))


def drawn(c, s: Se.Search, at: list[int]) -> tuple[DataFrame, DataFrame]:
    """Sample and validation rows of the origins ``at``, not yet worked out: an origin's sample does not depend on the others."""
    d = feature_rows(c)
    iv = materialize(Se.interval_table(c.spark, at, s), "intervals")
    return Se.nested_sample(d, iv, s), Se.validation_rows(d, iv, s)


def samples(c, s: Se.Search) -> tuple[DataFrame, DataFrame]:
    sample, valid = drawn(c, s, origins(c))
    return materialize(sample, "nested-sample"), materialize(valid, "validation")


def _counts(name: str, table: str) -> str:
    return f"{name} AS (SELECT s.entity, s.bin, " + ", ".join(f"count(x.t) FILTER (WHERE x.t >= s.t - {h * HOUR}) AS c{h}" for h in WINDOWS) + f" FROM scores s LEFT JOIN {table} x ON x.entity = s.entity AND x.t >= s.t - {DAY} AND x.t < s.t GROUP BY ALL)"


ROWS = _counts("hc", "faults") + ", " + _counts("lc", "tel") + f""", sx AS (SELECT min(bin) AS lo, max(bin) AS hi FROM scores),
ft AS (SELECT s.entity, s.bin, s.label, {", ".join(f"least({HISTORY.most}, hc.c{h}) AS hist_{h}, least({LOAD.most}, lc.c{h}) AS load_{h}" for h in WINDOWS)} FROM scores s JOIN hc ON hc.entity = s.entity AND hc.bin = s.bin JOIN lc ON lc.entity = s.entity AND lc.bin = s.bin, sx WHERE s.bin <= hi - {HORIZON}),
og AS (SELECT unnest(range(({at(1, 2, 'scores')} + {PER_DAY - 1}) // {PER_DAY} * {PER_DAY}, hi + 1, {PER_DAY})) AS origin FROM sx)"""


def sample_sql(s: Se.Search) -> str:
    """Spans, nested sample and validation rows."""
    return f"""sp AS (SELECT origin, origin - {2 * s.purge + s.validation * s.day} AS t_hi, origin - {s.purge + s.validation * s.day} AS v_lo, origin - {s.purge} AS v_hi FROM og),
tr AS (SELECT sp.origin, ft.*, t_hi - bin AS reach FROM ft JOIN sp ON bin >= t_hi - {max(s.lengths) * s.day} AND bin < t_hi), tp AS (SELECT origin, sum(label) AS p FROM tr GROUP BY 1),
tn AS (SELECT tr.*, row_number() OVER (PARTITION BY origin ORDER BY {hsh(s.seed)}, entity, bin) AS r FROM tr WHERE label = 0),
sm AS (SELECT * FROM tr WHERE label = 1 UNION ALL SELECT tn.* EXCLUDE (r) FROM tn JOIN tp ON tp.origin = tn.origin WHERE r <= least({s.cap}, floor(p * {s.ratio})))"""


def score_sql(s: Se.Search, hours: tuple[int, ...], names: tuple[str, ...], x: str) -> str:
    """``lg{x}``: the score of every validation row under every setting; ``q{x}``: its AP."""
    grid = f"(SELECT unnest([{', '.join(map(str, s.lengths))}]) AS days)"
    rates = " UNION ALL ".join(f"SELECT origin, days, {h} AS hours, {k} AS sel, {n}_{h} AS b, (sum(label) + 1) / (count(*) + 2)::DOUBLE AS rate FROM sm, {grid} WHERE reach <= days * {s.day} GROUP BY ALL" for h in hours for k, n in enumerate(names))
    rows = " UNION ALL ".join(f"SELECT origin, entity, bin, label, {h} AS hours, {', '.join(f'{n}_{h} AS b{k}' for k, n in enumerate(names))} FROM ft JOIN sp ON bin >= v_lo AND bin < v_hi" for h in hours)
    total = " + ".join(f"coalesce(r{k}.rate, 0.5)" for k in range(len(names)))
    joins = " ".join(f"LEFT JOIN rt{x} r{k} ON r{k}.origin = v.origin AND r{k}.days = g.days AND r{k}.hours = v.hours AND r{k}.sel = {k} AND r{k}.b = v.b{k}" for k in range(len(names)))
    quality = ap_sql(["origin", "days", "hours"], "score", f"lg{x}").replace("hist AS", f"hh{x} AS").replace("FROM hist)", f"FROM hh{x})").replace("cum AS", f"cu{x} AS").replace("FROM cum ", f"FROM cu{x} ").replace("q AS", f"qq{x} AS")
    return f"""rt{x} AS ({rates}), vr{x} AS ({rows}), lg{x} AS (SELECT v.origin, g.days, v.hours, v.label, ({total}) / {len(names)}.0::DOUBLE AS score FROM vr{x} v JOIN (SELECT DISTINCT origin, days, hours FROM rt{x}) g ON g.origin = v.origin AND g.hours = v.hours {joins}),
{quality}, q{x} AS (SELECT * REPLACE (round(ap, 9) AS ap), row_number() OVER (PARTITION BY origin ORDER BY round(ap, 9) DESC, days DESC, hours) = 1 AS chosen FROM qq{x})"""


SEARCH = ROWS + ", " + sample_sql(GRID) + ", " + score_sql(GRID, WINDOWS, ("load", "hist"), "a")


def searched(c) -> tuple[DataFrame, DataFrame]:
    """Scores of all settings and their quality; the scores are looked up in the rates, never written."""
    sample, valid = drawn(c, GRID, origins(c))
    valid = materialize(valid, "validation")
    scores = Se.rate_scores(sample, valid, GRID, [LOAD, HISTORY], list(WINDOWS))
    return scores, materialize(Se.setting_quality(scores), "search-quality")


@plan("window_search", "M18 K6", ("scores", "tel", "faults"), SEARCH + " SELECT origin, days::BIGINT AS days, hours::BIGINT AS hours, rows, positives, ap, chosen FROM qa", "ap")
def _(c):
    """7, 14, 21 days x 1, 6, 24 hours at every daily origin: AP of the mean of two selectors, and the choice."""
    return searched(c)[1]


STATE = """, cy AS (SELECT origin, row_number() OVER (ORDER BY origin) AS r, list(ap ORDER BY days, hours) AS l FROM qa GROUP BY 1),
mf AS (SELECT 0::BIGINT AS r, 0::BIGINT AS origin, 0::BIGINT AS ix, 0.0::DOUBLE AS score, 0::BIGINT AS same, 0.0::DOUBLE AS conf, [0, 0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS book, 'start' AS action
 UNION ALL SELECT r, origin, nix, nscore, CASE WHEN ix > 0 AND nix = ix THEN same + 1 ELSE 1 END, nbook[nix], nbook, CASE WHEN keep THEN 'hold' WHEN can THEN 'rescan' WHEN ix > 0 AND conf < 0.65 THEN 'low_confidence' ELSE 'search' END
 FROM (SELECT *, list_transform([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: 0.7::DOUBLE * book[i] + CASE WHEN i = nix THEN 0.3::DOUBLE ELSE 0 END) AS nbook
 FROM (SELECT *, CASE WHEN keep THEN ix ELSE list_position(al, list_max(al))::BIGINT END AS nix, CASE WHEN keep THEN quick ELSE list_max(al) END AS nscore
 FROM (SELECT *, can AND (score - quick) / greatest(score, 1e-9) <= 0.15 AS keep, list_transform([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: CASE WHEN ix = 0 OR (i - 1) // 3 >= (ix - 1) // 3 OR (l[i] - score) / greatest(score, 1e-9) >= 0.05 THEN l[i] ELSE -1 END) AS al
 FROM (SELECT cy.r, cy.origin, l, ix, score, same, conf, book, ix > 0 AND same >= 2 AND conf >= 0.65 AS can, CASE WHEN ix > 0 THEN l[ix] ELSE 0 END AS quick FROM mf JOIN cy ON cy.r = mf.r + 1)))))
SELECT origin, ([7, 14, 21][(ix - 1) // 3 + 1])::BIGINT AS days, ([1, 6, 24][(ix - 1) % 3 + 1])::BIGINT AS hours, score, same, conf, action, (SELECT count(*) FROM lga WHERE lga.origin = mf.origin AND days = [7, 14, 21][(ix - 1) // 3 + 1] AND hours = [1, 6, 24][(ix - 1) % 3 + 1]) AS scored FROM mf WHERE r > 0"""


@plan("momentum_control", "M19 K6", ("scores", "tel", "faults"), SEARCH + STATE, "score conf")
def _(c):
    """Hold or search again over the settings of ``window_search``; stopped after a third of the origins and gone on with."""
    scores, quality = searched(c)
    cycles = quality.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct(F.col("days").cast("bigint").alias("days"), F.col("hours").cast("bigint").alias("hours"), "ap"))).alias("scores"))
    step, path, o = C.momentum_step(), scratch_path(c.spark, "controller"), origins(c)
    zero = c.spark.range(1).select(C.momentum_zero().alias("s"))
    run = lambda part: Se.hold_or_search(path, materialize(cycles, "cycles"), scores, part, lambda d: d.select(step(F.col("s"), F.struct("scores")).alias("s")), zero)
    run(o[:len(o) // 3])
    states, chosen = run(o)
    return states.drop("book").join(chosen.groupBy("origin").agg(F.count(F.lit(1)).alias("scored")), "origin")


MODELS = {"history": HISTORY, "load": LOAD}
LENGTHS = ROWS + ", " + sample_sql(SLIDING) + ", " + score_sql(SLIDING, (24,), ("hist",), "h") + ", " + score_sql(SLIDING, (24,), ("load",), "l") + ", ls AS (SELECT 'history' AS model, * FROM qh UNION ALL SELECT 'load', * FROM ql)"


def lengths(c) -> DataFrame:
    sample, valid = samples(c, SLIDING)
    parts = [Se.setting_quality(Se.rate_scores(sample, valid, SLIDING, [x], [24])).withColumn("model", F.lit(n)) for n, x in MODELS.items()]
    return materialize(reduce(DataFrame.unionByName, parts), "lengths")


@plan("length_selection", "M24", ("scores", "tel", "faults"), LENGTHS + " SELECT model, origin, days::BIGINT AS days, rows, positives, ap, chosen FROM ls", "ap")
def _(c):
    """9, 12 or 15 days for each model at every origin, 36 h purge on both sides of three days of validation."""
    return lengths(c).select("model", "origin", "days", "rows", "positives", "ap", "chosen")


@plan("history_length_selection", "M25", ("scores", "tel", "faults"), ROWS + ", " + sample_sql(GRID) + ", " + score_sql(GRID, (24,), ("hist",), "h") + " SELECT origin, days::BIGINT AS days, rows, positives, ap, chosen FROM qh", "ap")
def _(c):
    """7, 14 or 21 days at every origin; the history model selects."""
    sample, valid = drawn(c, GRID, origins(c))
    return Se.setting_quality(Se.rate_scores(sample, valid, GRID, [HISTORY], [24])).select("origin", "days", "rows", "positives", "ap", "chosen")


@plan("window_stability", "A38", ("scores", "tel", "faults"), LENGTHS + """ SELECT model, avg(ap) AS mean, stddev_pop(ap) AS std, min(ap) AS min, max(ap) AS max, count(*) FILTER (WHERE days = 9) AS chosen_9, count(*) FILTER (WHERE days = 12) AS chosen_12,
 count(*) FILTER (WHERE days = 15) AS chosen_15 FROM ls WHERE chosen GROUP BY 1""", "mean std min max")
def _(c):
    """The lengths that ``length_selection`` chose and the AP they had."""
    return C.stability(lengths(c).where("chosen"), ["model"], "ap", "days", list(SLIDING.lengths))


@plan("training_cost", "A41", ("scores", "tel", "faults"), ROWS + ", " + sample_sql(GRID) + f""", go AS (SELECT origin FROM og QUALIFY row_number() OVER (ORDER BY origin) % 5 = 1), ft7 AS (SELECT arm, origin, days, count(*) FILTER (WHERE reach <= days * {PER_DAY}) AS n
 FROM sm JOIN go USING (origin), (SELECT unnest([7, 14, 21]) AS days), (SELECT unnest(['both', 'history']) AS arm) GROUP BY ALL)
SELECT arm, count(*) AS fits, avg(n) AS mean_samples, count(*) FILTER (WHERE days = 7) AS fits_7d, count(*) FILTER (WHERE days = 14) AS fits_14d, count(*) FILTER (WHERE days = 21) AS fits_21d, true AS timed FROM ft7 GROUP BY 1""", "mean_samples")
def _(c):
    """Measured fits of two feature sets: samples are exact, seconds only known to be positive and to add up."""
    path, o = scratch_path(c.spark, "trace"), origins(c)[::5]
    sample, valid = drawn(c, GRID, o)
    sample = materialize(sample, "nested-sample")
    for arm, cols in (("history", ["hist_24"]), ("both", ["hist_24", "load_24"])):
        Se.fit_scores(sample, valid, GRID, o, {24: [Mo.logistic(cols, iters=10)]}, arm, path)
    trace = Se.read_trace(c.spark, path)
    out = C.training_cost(trace, list(GRID.lengths))
    total = trace.agg(F.sum("seconds")).scalar()
    timed = (F.col("median_seconds") > 0) & (F.col("total_seconds") >= F.col("median_seconds")) & (F.col("total_seconds") < total)
    return out.select("arm", "fits", "mean_samples", "fits_7d", "fits_14d", "fits_21d", timed.alias("timed"))
