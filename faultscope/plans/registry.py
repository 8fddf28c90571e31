"""Named plans: a builder, its oracle text and the survey rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..canonical import Canon
from .oracle import compose


@dataclass(frozen=True)
class Plan:
    name: str
    covers: str
    build: Callable[[Canon], DataFrame]
    sql: str | None
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Canon(spark, sf_dir)), self.digits)


PLANS: dict[str, Plan] = {}


def nudge(digits: int) -> float:
    """Added before rounding on both engines: exact half-way values then round the same way
    whatever the last bit of the sum behind them is."""
    return float(f"1.7e-{digits + 2}")


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles (-0.0 becomes 0.0); narrow integers become bigint."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = (F.round(c + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def plan(name: str, covers: str, uses: tuple[str, ...] = (), sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a plan. ``doubles`` lists the double columns to round in the SQL."""

    def deco(fn):
        text = None
        if sql is not None:
            text = compose(uses, sql)
            if doubles:
                rep = ", ".join(f"round({c}::DOUBLE + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
                text = f"SELECT * REPLACE ({rep}) FROM ({text}) AS q"
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, covers, fn, text, digits)
        return fn

    return deco
