"""The canonical model as SQL text, for the statements DuckDB runs."""

from __future__ import annotations

from ..canonical import T0

H = 3_600_000_000
D = 24 * H
STEP = 6 * H

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tel0": ((), """SELECT user_id AS entity, user_id // 8 AS grp, user_id % 8 AS slot, epoch_us(ts) AS t,
        round(value * 100) AS util, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS temp,
        event_type, event_id FROM events"""),
    "tel": (("tel0",), """SELECT entity, grp, slot, t, util, temp, (util*3 + temp*5) % 701.0 AS power,
        (util*7 + temp*13) % 97.0 AS fb, event_type, event_id FROM tel0"""),
    "faults": (("tel",), """SELECT entity, grp, slot, t, (CASE WHEN temp % 2 = 0 THEN 31 ELSE 43 END)::BIGINT AS code, event_id
        FROM tel WHERE event_type = 'error'"""),
    "flog": (("tel",), """SELECT entity, grp, t, CASE WHEN event_type = 'error' THEN CASE WHEN temp % 2 = 0 THEN 31.0 ELSE 43.0 END
        WHEN event_type = 'signup' THEN NULL ELSE 0.0 END AS code FROM tel"""),
    "binned": (("tel",), f"""SELECT entity, grp, slot, (t - {T0}) // {STEP} AS bin,
        avg(util) AS util_mean, count(util) AS util_n, avg(temp) AS temp_mean, count(temp) AS temp_n,
        avg(power) AS power_mean, count(power) AS power_n, avg(fb) AS fb_mean, count(fb) AS fb_n
        FROM tel GROUP BY ALL"""),
    "ents": (("binned",), "SELECT DISTINCT entity, grp, slot FROM binned"),
    "bins": (("binned",), "SELECT unnest(range((SELECT min(bin) FROM binned), (SELECT max(bin) FROM binned) + 1)) AS bin"),
    "grid": (("ents", "bins", "binned"), """SELECT e.entity, e.grp, e.slot, b.bin,
        util_mean, coalesce(util_n, 0) AS util_n, temp_mean, coalesce(temp_n, 0) AS temp_n,
        power_mean, coalesce(power_n, 0) AS power_n, fb_mean, coalesce(fb_n, 0) AS fb_n
        FROM ents e CROSS JOIN bins b LEFT JOIN binned d ON d.entity = e.entity AND d.bin = b.bin"""),
    "decisions": (("grid",), f"SELECT entity, grp, slot, bin, {T0} + bin * {STEP} AS t FROM grid"),
    "scores": (("decisions", "faults"), f"""SELECT *, ((entity*37 + bin*101 + entity*bin) % 997 + 0.5) / 997.0::DOUBLE AS p1,
        ((entity*53 + bin*17 + k*211) % 499 + 0.5) / 499.0::DOUBLE AS p2, bin // 4 AS origin FROM (
        SELECT d.entity, d.grp, d.slot, d.bin, d.t,
        count(f.t) FILTER (WHERE f.t < d.t)::BIGINT AS k,
        (count(f.t) FILTER (WHERE f.t > d.t) > 0)::BIGINT AS label
        FROM decisions d LEFT JOIN faults f ON f.entity = d.entity AND f.t >= d.t - 7*{D} AND f.t <= d.t + {D}
        GROUP BY ALL)"""),
    "jobs": ((), """SELECT o_orderkey AS job_id, epoch_us(o_orderdate) AS submit_t, epoch_us(s) AS start_t, epoch_us(e) AS end_t,
        (epoch_us(e) - epoch_us(s)) / 1000000.0::DOUBLE AS duration, round(o_totalprice) AS gpu_time, gpu_num,
        (gpu_num + 7) // 8 AS node_num, gpu_num * 16 AS cpu_num, o_orderpriority AS type, o_custkey AS "user",
        CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'CANCELLED' END AS state
        FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e, count(*) AS gpu_num
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""),
}


def at(part: int, of: int, table: str = "tel") -> str:
    """Bin at a share of the recording (``Canon.at``); ``table`` is ``tel`` or one with a ``bin``."""
    b = f"(t - {T0}) // {STEP}" if table == "tel" else "bin"
    return f"(SELECT min({b}) + (max({b}) - min({b}) + 1) * {part} // {of} FROM {table})"


def compose(uses: tuple[str, ...], body: str) -> str:
    """WITH clause of the needed CTEs (dependencies first) in front of the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for u in uses:
        visit(u)
    body = body.strip()
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    if not parts:
        return body if body[:6].upper() == "SELECT" else f"WITH RECURSIVE {body}"
    glue = " " if body[:6].upper() == "SELECT" else ", "
    return "WITH RECURSIVE " + ",\n".join(parts) + glue + "\n" + body
