"""Data-quality and contract audits; each returns violations or PASS/FAIL rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import DAY, idiv, mix_hash, value_text
from .scan import scan


def time_axis_audit(df: DataFrame, order: str, t: str, step: int, width: int = 1 << 20) -> DataFrame:
    """Duplicates, reversals and irregular steps in file order, largest gap, expected rows."""
    d = scan(df.select(order, t), [], [order], idiv(order, width), lag={"_p": t})
    gap = F.col(t) - F.col("_p")
    return d.agg(
        F.count("*").alias("rows"), F.min(t).alias("first_t"), F.max(t).alias("last_t"),
        F.count_if(gap == 0).alias("duplicates"), F.count_if(gap < 0).alias("out_of_order"),
        F.count_if(gap != step).alias("irregular"), F.max(gap).alias("max_gap"),
        (idiv(F.max(t) - F.min(t), step) + 1).alias("expected_rows"))


def entity_diff(frames: dict[str, DataFrame], reference: DataFrame, key: str) -> DataFrame:
    """Entities missing from or extra in each source against the reference."""
    ref = reference.select(key).distinct()
    parts = []
    for name, f in frames.items():
        ids = f.select(key).distinct()
        parts.append(ref.join(ids, key, "left_anti").select(F.lit(name).alias("source"), F.lit("missing").alias("difference"), key))
        parts.append(ids.join(ref, key, "left_anti").select(F.lit(name).alias("source"), F.lit("extra").alias("difference"), key))
    return reduce(DataFrame.unionByName, parts)


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Content hash of a table as a multiset of rows, which any SQL engine reproduces.

    A row is the md5 of its columns' portable texts (``value_text``) in the order of ``cols``; the
    hash is the number of rows and the sums of the first and of the next sixty bits of the md5, as
    exact decimals (text). Order and partitions do not matter; a changed value, a row more or
    less, a repeated row and a NULL moved to another column alter it. An empty table has sums of 0.
    """
    kinds = dict(df.dtypes)
    row = F.md5(F.concat_ws(",", *[value_text(c, kinds[c]) for c in cols or df.columns]))
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(28,0)")
    total = lambda at: F.coalesce(F.sum(part(at)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), total(1).alias("first_sum"), total(16).alias("second_sum"))


def key_fingerprint(df: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """Fingerprint of whole-number key columns that any SQL engine can reproduce."""
    h = mix_hash(seed, *keys)
    return df.select(h.alias("h"), *keys).agg(
        F.count("*").alias("rows"), F.bit_xor("h").alias("xor_hash"), F.sum("h").alias("sum_hash"),
        *[F.min(k).alias(f"min_{k}") for k in keys], *[F.max(k).alias(f"max_{k}") for k in keys])


def _verdict(name: str, bad: Column, severity: str = "FAIL") -> Column:
    return F.struct(F.lit(name).alias("check"), F.when(bad == 0, "PASS").otherwise(severity).alias("status"), bad.cast("bigint").alias("violations"))


def audit_risk_tape(df: DataFrame, t0: int, t1: int) -> DataFrame:
    """Contract rows: schema, window, finite score, rank, uniqueness, provenance."""
    required = ["decision_t", "entity", "risk_score", "risk_rank"]
    missing = [c for c in required if c not in df.columns]
    spark = df.sparkSession
    if missing:
        return spark.range(1).select(F.explode(F.array(_verdict("required_schema", F.lit(len(missing))))).alias("x")).select("x.*")
    s, t = F.col("risk_score"), F.col("decision_t")
    keys = df.groupBy("decision_t", "entity").agg(
        F.count("*").alias("n"), F.count_if(t.isNull()).alias("bad_t"), F.count_if(~t.between(t0, t1)).alias("outside"),
        F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad_s"),
        F.count_if(F.coalesce(F.col("risk_rank") < 1, F.lit(True))).alias("bad_r"))
    a = keys.agg(F.sum("bad_t").alias("bt"), F.sum("outside").alias("bo"), F.sum("bad_s").alias("bs"), F.sum("bad_r").alias("br"),
                 F.sum(F.col("n") - 1).alias("dup"))
    blocked = lambda c: F.struct(F.lit(c[0]).alias("check"), F.lit("PASS" if c[1] in df.columns else "BLOCKED").alias("status"), F.lit(0).cast("bigint").alias("violations"))
    rows = [_verdict("required_schema", F.lit(0)), _verdict("decision_time_parseable", F.col("bt")), _verdict("decision_time_coverage", F.col("bo"), "WARN"),
            _verdict("finite_risk_score", F.col("bs")), _verdict("positive_risk_rank", F.col("br")), _verdict("unique_decision_entity", F.col("dup")),
            blocked(("out_of_fold_provenance", "model_fold")), blocked(("leakage_cutoff", "feature_cutoff_t"))]
    return a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def audit_score_tape(tape: DataFrame, population: Column, step: int, k: int, cutoff: int) -> DataFrame:
    """Full population per time, steady cadence, scores in [0, 1], rank a permutation, cutoff offset.

    A rank column is a permutation of 1..n exactly when its values are distinct,
    start at 1 and end at n.
    """
    per = tape.groupBy("t").agg(
        F.count("*").alias("n"), F.count_if((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).alias("bad_score"),
        F.count_distinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.count_if((F.col("rank") <= k) != F.col("in_top")).alias("bad_top"),
        F.count_if(F.col("feature_cutoff_t") != F.col("t") - cutoff).alias("bad_cutoff"))
    per = scan(per, [], ["t"], idiv("t", DAY), lag={"_p": "t"})
    a = per.agg(
        F.count_if(F.col("n") != population).alias("a"), F.count_if(F.col("t") - F.col("_p") != step).alias("b"), F.sum("bad_score").alias("c"),
        F.count_if((F.col("ranks") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("d"),
        F.sum("bad_top").alias("e"), F.sum("bad_cutoff").alias("f"))
    names = {"full_population": "a", "contiguous_cadence": "b", "score_in_unit_interval": "c", "rank_is_permutation": "d", "top_flag": "e", "cutoff_offset": "f"}
    return a.select(F.explode(F.array(*[_verdict(n, F.col(c)) for n, c in names.items()])).alias("x")).select("x.*")


def prediction_parity(stored: DataFrame, rescored: DataFrame, keys: list[str], score: str, tol: float) -> DataFrame:
    """Largest difference and number of rows beyond the tolerance; unmatched rows count."""
    a = stored.select(*keys, F.col(score).alias("_a"))
    b = rescored.select(*keys, F.col(score).alias("_b"))
    j = a.join(b, keys, "full_outer")
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(F.count("*").alias("rows"), F.count_if(d.isNull()).alias("unmatched"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_diff"),
                 F.count_if(d > tol).alias("beyond_tolerance"))


def identity_check(df: DataFrame, stored: str, expected: Column, tol: float = 1e-6) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(~(F.abs(F.col(stored) - expected) <= tol)).alias("violations"))


def reaggregate_check(parts: DataFrame, summary: DataFrame, keys: list[str], cols: list[str], tol: float = 1e-12) -> DataFrame:
    """Block rows must sum to the reported summary."""
    s = parts.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    j = summary.join(s, keys, "full_outer")
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) > tol, F.lit(True)) for c in cols])
    return j.withColumn("violation", bad).select(*keys, "violation")


def leakage_checks(trace: DataFrame, purge: int, horizon: int) -> DataFrame:
    """Rows of a training trace that break purge or label maturity (must be empty)."""
    late = F.col("latest_train_bin") > F.col("origin") - purge
    immature = F.col("latest_train_bin") + horizon > F.col("origin")
    return trace.withColumns({"purge_violation": late, "immature_label": immature}).where(late | immature)


def expected_population(df: DataFrame, entity: str) -> Column:
    return df.agg(F.count_distinct(entity)).scalar()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Window",)]
