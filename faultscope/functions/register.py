"""SQL names for the scalar functions (temporary SQL functions, no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Name, arguments, body.
SQL_FUNCTIONS = [
    ("fs_safe_ratio", "n DOUBLE, d DOUBLE", "CASE WHEN abs(d) > 1e-4D AND n IS NOT NULL THEN greatest(-100D, least(100D, try_divide(n, d))) ELSE 0D END"),
    ("fs_eps_ratio", "n DOUBLE, d DOUBLE", "n / (d + 1e-4D)"),
    ("fs_logit", "p DOUBLE", "ln(greatest(1e-6D, least(1D - 1e-6D, p)) / (1D - greatest(1e-6D, least(1D - 1e-6D, p))))"),
    ("fs_expit", "z DOUBLE", "1D / (1D + exp(-z))"),
    ("fs_restore_prior", "p DOUBLE, pi DOUBLE, s DOUBLE", "(p / (1 - p) * (pi / (1 - pi)) / (s / (1 - s))) / (1 + p / (1 - p) * (pi / (1 - pi)) / (s / (1 - s)))"),
    ("fs_natural_probability", "p DOUBLE, prior DOUBLE", "1D / (1D + exp(-(ln(p / (1 - p)) + ln(prior / (1 - prior)))))"),
    ("fs_event_weight", "k BIGINT, alpha DOUBLE, cap DOUBLE", "least(cap, power(1D / (k + 1), alpha))"),
    ("fs_report_weight", "k BIGINT, cold DOUBLE, rep DOUBLE", "rep + (cold - rep) / (k + 1)"),
    ("fs_fuse", "p1 DOUBLE, p2 DOUBLE, w DOUBLE", "w * p1 + (1D - w) * p2"),
    ("fs_blend", "z DOUBLE, m DOUBLE, gamma DOUBLE", "(z + gamma * m) / (1D + gamma)"),
]


def register_functions(spark: SparkSession) -> list[str]:
    for name, args, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    return [n for n, _, _ in SQL_FUNCTIONS]
