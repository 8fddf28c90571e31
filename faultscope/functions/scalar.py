"""Column expressions. Everything stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR

# Fixed values.
RATIO_FLOOR = 1e-4
RATIO_LIMIT = 100.0
PROB_EPS = 1e-6
PRIOR_EPS = 1e-7
WEIGHT_FLOOR = 0.05


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def idiv(a, b) -> Column:
    """Floor division on integers (exact, no detour over double)."""
    a, b = _c(a), b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def bin_index(t, t0: int, step: int) -> Column:
    return idiv(_c(t) - F.lit(t0), step)


def local_day(t, offset_us: int = 9 * HOUR) -> Column:
    """Day number in a fixed-offset zone (block keys use +09:00 by default)."""
    return idiv(_c(t) + F.lit(offset_us), DAY)


def day_key(t, tz: str = "Asia/Seoul") -> Column:
    """``yyyy-MM-dd`` in a named zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(_c(t)), tz), "yyyy-MM-dd")


def half_day_key(t, tz: str = "Asia/Seoul") -> Column:
    local = F.from_utc_timestamp(F.timestamp_micros(_c(t)), tz)
    half = F.when(F.hour(local) < 12, "AM").otherwise("PM")
    return F.concat_ws("-", F.date_format(local, "yyyy-MM-dd"), half)


def hour_of_day(t) -> Column:
    return F.pmod(idiv(t, HOUR), F.lit(24))


def day_of_week(t) -> Column:
    """Monday = 0 (1970-01-01 was a Thursday)."""
    return F.pmod(idiv(t, DAY) + 3, F.lit(7))


def is_weekend(t) -> Column:
    return F.when(day_of_week(t) >= 5, 1).otherwise(0).cast("bigint")


def parse_ts(col, fmt: str | None = None) -> Column:
    """String to timestamp, NULL when malformed."""
    return F.try_to_timestamp(_c(col), F.lit(fmt)) if fmt else F.try_to_timestamp(_c(col))


def entity_group(col) -> Column:
    """Text before the last dash."""
    return F.regexp_extract(_c(col), r"^(.*)-[^-]*$", 1)


def entity_slot(col) -> Column:
    """Number after the last dash."""
    return F.substring_index(_c(col), "-", -1).cast("bigint")


def normalize_node(col) -> Column:
    """Trailing ``10-140-a-b`` as a dotted address, NULL when absent."""
    return F.nullif(F.translate(F.regexp_extract(_c(col), r"(10-140-\d+-\d+)$", 1), "-", "."), F.lit(""))


def valid_code(col) -> Column:
    """Finite, whole and non-negative, of any size a bigint holds; everything else is 'not observed'.

    Whole-number columns keep their digits: only the test looks at the double.
    """
    c = _c(col).cast("double")
    ok = (c >= 0) & (c < F.lit(2.0**63)) & (c == F.rint(c))
    return F.when(ok, _c(col).cast("bigint"))


def clean(col) -> Column:
    """End-of-assembly cleaning: NULL, NaN and infinities become 0; finite values stay."""
    c = _c(col).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c).otherwise(F.lit(0.0))


def safe_ratio(num, den) -> Column:
    n, d = _c(num), _c(den)
    r = F.greatest(F.lit(-RATIO_LIMIT), F.least(F.lit(RATIO_LIMIT), n / d))
    return F.when((F.abs(d) > RATIO_FLOOR) & n.isNotNull(), r).otherwise(F.lit(0.0))


def eps_ratio(num, den) -> Column:
    return _c(num) / (_c(den) + F.lit(RATIO_FLOOR))


def clip(col, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(col)))


def logit(p, eps: float = PROB_EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def expit(z, limit: float | None = None) -> Column:
    x = _c(z) if limit is None else clip(z, -limit, limit)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def restore_prior(p, true_prior, sample_prior) -> Column:
    """Odds correction for a model fitted on a re-balanced sample."""
    q = clip(p, PRIOR_EPS, 1 - PRIOR_EPS)
    pi = clip(true_prior, PRIOR_EPS, 1 - PRIOR_EPS)
    s = clip(sample_prior, PRIOR_EPS, 1 - PRIOR_EPS)
    odds = q / (1 - q) * (pi / (1 - pi)) / (s / (1 - s))
    return odds / (1 + odds)


def natural_probability(p, prior) -> Column:
    """Balanced-fit probability moved to the natural prior."""
    return expit(logit(p) + logit(prior))


def pareto_weight(k, alpha=1.0, cap: float = 0.6, floor: float | None = WEIGHT_FLOOR) -> Column:
    """Branch-1 weight that falls with the number of past events."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    w = F.least(F.lit(float(cap)) if not isinstance(cap, Column) else cap, F.pow(1.0 / (_c(k) + 1.0), a))
    return w if floor is None else F.least(F.lit(1.0), F.greatest(F.lit(float(floor)), w))


def report_weight(k, cold: float, repeat: float, alpha: float = 1.0) -> Column:
    """Between ``repeat`` (many events) and ``cold`` (none)."""
    return F.lit(repeat) + F.lit(cold - repeat) * F.pow(1.0 / (_c(k) + 1.0), F.lit(float(alpha)))


def fuse(p1, p2, w) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return w * _c(p1) + (F.lit(1.0) - w) * _c(p2)


def inertia_blend(z, m, gamma) -> Column:
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return (_c(z) + g * _c(m)) / (F.lit(1.0) + g)


def residual_basis(p1, p2, m1=None, m2=None, scale: float = 6.0) -> dict[str, Column]:
    """Second-order basis of the scaled logits, plus three terms per memory."""
    z1, z2 = logit(p1) / scale, logit(p2) / scale
    cols = {"b0": F.lit(1.0), "b1": z1, "b2": z2, "b11": z1 * z1, "b22": z2 * z2, "b12": z1 * z2}
    for tag, z, m in (("1", z1, m1), ("2", z2, m2)):
        if m is not None:
            s = _c(m) / scale
            cols |= {f"m{tag}": s, f"m{tag}m{tag}": s * s, f"z{tag}m{tag}": z * s}
    return cols


def norm_ap(ap, prevalence) -> Column:
    return clip((_c(ap) - _c(prevalence)) / F.greatest(1.0 - _c(prevalence), F.lit(1e-9)), 0.0, 1.0)


def recency_weight(age_days, half_life_days: float) -> Column:
    """Exponential recency weight; divide by its mean over the sample."""
    return F.exp(F.lit(-math.log(2.0)) * _c(age_days) / half_life_days)


def dcg_discount(rank) -> Column:
    return F.lit(1.0) / F.log2(_c(rank) + 1.0)


def ideal_dcg(n, k: int) -> Column:
    """Best DCG for ``n`` positives in a list of ``k``: prefix sums over a fixed array."""
    table, total = [0.0], 0.0
    for r in range(1, k + 1):
        total += 1.0 / math.log2(r + 1)
        table.append(total)
    return F.element_at(F.array(*[F.lit(x) for x in table]), (F.least(_c(n), F.lit(k)) + 1).cast("int"))


def activity_state(col, cuts=(10.0, 50.0)) -> Column:
    c = _c(col)
    return (
        F.when(c < cuts[0], "idle").when(c < cuts[1], "low").when(c >= cuts[1], "high")
    )


def event_label(code, entity, episode) -> Column:
    return F.format_string("xid%d_%s_e%d", _c(code), _c(entity).cast("string"), _c(episode))


def cluster_label(n, width: int = 5) -> Column:
    return F.concat(F.lit("cluster_"), F.lpad(_c(n).cast("string"), width, "0"))


_M31 = 2147483647


def mix_hash(seed: int, *keys) -> Column:
    """Seeded hash in [0, 2^31-1) from integer arithmetic only.

    Reproducible on any engine with 64-bit integers, so every sample that is
    drawn with it can be checked from plain SQL.
    """
    h = F.lit(int(seed) % _M31).cast("bigint")
    for k in keys:
        h = F.pmod((h + F.pmod(_c(k).cast("bigint"), F.lit(_M31))) * F.lit(48271) + F.lit(11), F.lit(_M31))
        h = F.pmod(h * F.lit(69621) + F.lit(7), F.lit(_M31))
    return F.pmod(F.pmod(h, F.lit(46337)) * h, F.lit(_M31))


def mix_hash_sql(seed: int, *keys: str) -> str:
    """The same hash as SQL text (used by the oracle statements)."""
    h = f"{int(seed) % _M31}::BIGINT"
    for k in keys:
        h = f"((({h}) + (({k})::BIGINT % {_M31})) * 48271 + 11) % {_M31}"
        h = f"(({h}) * 69621 + 7) % {_M31}"
    return f"(((({h}) % 46337) * ({h})) % {_M31})"


def value_text(col: str, kind: str) -> Column:
    """A column as text that every SQL engine writes alike; NULL is ``n``.

    ``kind`` is the Spark type name. Doubles and floats are written as their exact whole-number
    mantissa and power of two (so no engine's printing of decimals matters; 0.0 and -0.0 are
    equal), times as microseconds, dates as days, strings and bytes as the md5 of their bytes.
    """
    c = F.col(f"`{col}`")
    if kind in ("double", "float"):
        a = F.abs(c.cast("double"))
        e = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022)).cast("int")
        m = a / F.pow(F.lit(2.0), e)
        m, e = F.when(m < 1, m * 2).when(m >= 2, m / 2).otherwise(m), F.when(m < 1, e - 1).when(m >= 2, e + 1).otherwise(e)
        exact = F.concat(F.when(c < 0, "-").otherwise(""), (m * F.lit(2.0 ** 52)).cast("bigint").cast("string"), F.lit("e"), e.cast("string"))
        text = F.when(F.isnan(c), "nan").when(a == float("inf"), F.when(c < 0, "-inf").otherwise("inf")).when(c == 0, "0").otherwise(exact)
    elif kind in ("bigint", "int", "smallint", "tinyint") or kind.startswith("decimal"):
        text = c.cast("string")
    elif kind == "boolean":
        text = F.when(c, "1").otherwise("0")
    elif kind == "date":
        text = F.unix_date(c).cast("string")
    elif kind in ("timestamp", "timestamp_ntz"):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    elif kind in ("string", "binary"):
        text = F.md5(c.cast("binary"))
    else:
        raise TypeError(f"{col}: no portable text for {kind}")
    return F.when(c.isNull(), "n").otherwise(text)


def value_text_sql(col: str, kind: str) -> str:
    """``value_text`` as SQL text (used by the oracle statements)."""
    if kind == "double":
        e = f"greatest(least(floor(log2(abs({col}))), 1023), -1022)"
        m = f"(abs({col}) / pow(2.0, {e}))"
        exact = (f"(CASE WHEN {col} < 0 THEN '-' ELSE '' END) || CAST((CASE WHEN {m} < 1 THEN {m} * 2 WHEN {m} >= 2 THEN {m} / 2 ELSE {m} END) * 4503599627370496.0 AS BIGINT)"
                 f" || 'e' || CAST({e} + (CASE WHEN {m} < 1 THEN -1 WHEN {m} >= 2 THEN 1 ELSE 0 END) AS INT)")
        return f"(CASE WHEN {col} IS NULL THEN 'n' WHEN isnan({col}) THEN 'nan' WHEN isinf({col}) THEN CASE WHEN {col} < 0 THEN '-inf' ELSE 'inf' END WHEN {col} = 0 THEN '0' ELSE {exact} END)"
    if kind == "string":
        return f"(CASE WHEN {col} IS NULL THEN 'n' ELSE md5({col}) END)"
    return f"(CASE WHEN {col} IS NULL THEN 'n' ELSE CAST({col} AS VARCHAR) END)"


def score_chunk(order) -> Column:
    """Coarse monotone key of a real-valued order column.

    Log-spaced around zero, so that scores crowded near zero still spread over
    many chunks.
    """
    c = _c(order).cast("double")
    return F.floor(F.signum(c) * F.log1p(F.abs(c) * 1e6) * 1024.0).cast("bigint")
