"""The entity-time model on top of the given tables.

``events`` plays telemetry and faults, ``orders`` with ``lineitem`` the job
trace. Times are epoch microseconds (UTC) in ``t``; a bin is an integer index
from ``T0``. Readings are whole numbers held as doubles, so sums are exact and
do not depend on the order in which partitions are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.scalar import DAY, HOUR, bin_index, idiv, mix_hash
from .operators import grid as G
from .session import use_utc

T0 = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z, first full day of the recording
STEP = 6 * HOUR
GROUP_SIZE = 8
METRICS = ("util", "temp", "power", "fb")


@dataclass
class Canon:
    spark: SparkSession
    sf_dir: str
    step: int = STEP
    copies: int = 1  # of every entity, for timings on a larger grid

    def __post_init__(self):
        use_utc(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def telemetry(self) -> DataFrame:
        util = F.round(F.col("value") * 100)
        temp = F.get_json_object("props", "$.k").cast("double")
        events = self.table("events")
        if self.copies > 1:
            copy = F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1)))
            events = events.withColumn("_copy", copy).withColumn("user_id", F.col("user_id") + F.col("_copy") * F.lit(GROUP_SIZE * 1_000_000))
        return events.select(
            F.col("user_id").alias("entity"),
            idiv("user_id", GROUP_SIZE).alias("grp"),
            F.pmod("user_id", F.lit(GROUP_SIZE)).alias("slot"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
            util.alias("util"),
            temp.alias("temp"),
            F.pmod(util * 3 + temp * 5, F.lit(701.0)).alias("power"),
            F.pmod(util * 7 + temp * 13, F.lit(97.0)).alias("fb"),
            "event_type",
            "event_id",
        )

    @cached_property
    def faults(self) -> DataFrame:
        """Onsets: one row per fault record, two codes."""
        code = F.when(F.pmod("temp", F.lit(2.0)) == 0, 31).otherwise(43).cast("bigint")
        return self.telemetry.where(F.col("event_type") == "error").select(
            "entity", "grp", "slot", "t", code.alias("code"), "event_id"
        )

    @cached_property
    def log(self) -> DataFrame:
        """Fault log with healthy rows (0) and unobserved rows (NULL)."""
        code = (
            F.when(F.col("event_type") == "error", F.when(F.pmod("temp", F.lit(2.0)) == 0, 31).otherwise(43))
            .when(F.col("event_type") == "signup", F.lit(None))
            .otherwise(0)
        )
        return self.telemetry.select("entity", "grp", "t", code.cast("double").alias("code"))

    @cached_property
    def binned(self) -> DataFrame:
        """One row per (entity, bin) with data: means and valid counts."""
        return G.bin_means(self.telemetry, ["entity", "grp", "slot"], "t", T0, self.step, METRICS)

    @cached_property
    def span(self):
        """First and last bin as a scalar subquery over the time column alone."""
        t = self.telemetry.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        return t.select(F.struct(bin_index("lo", T0, self.step).alias("lo"), bin_index("hi", T0, self.step).alias("hi"))).scalar()

    @cached_property
    def first_last(self) -> tuple[int, int]:
        """First and last bin as numbers, for driver loops over origins."""
        row = self.telemetry.agg(F.min(bin_index("t", T0, self.step)), F.max(bin_index("t", T0, self.step))).first()
        return int(row[0]), int(row[1])

    def at(self, part: int, of: int) -> int:
        """Bin at a share of the recording; ``oracle.at`` is the same in SQL."""
        lo, hi = self.first_last
        return lo + (hi - lo + 1) * part // of

    @property
    def bounds(self):
        """First and last decision time, for the sweeps over decisions."""
        return F.lit(T0) + self.span["lo"] * F.lit(self.step), F.lit(T0) + self.span["hi"] * F.lit(self.step)

    @cached_property
    def grid(self) -> DataFrame:
        """Dense (entity, bin) grid; unobserved cells are NULL with count 0."""
        span = self.span
        dense = G.densify(self.binned, ["entity"], ["grp", "slot"], span["lo"], span["hi"])
        return G.fill_counts(dense, METRICS)

    @cached_property
    def decisions(self) -> DataFrame:
        """Decision rows at bin starts."""
        return self.grid.select("entity", "grp", "slot", "bin", (F.lit(T0) + F.col("bin") * F.lit(self.step)).alias("t"))

    @cached_property
    def scores(self) -> DataFrame:
        """Two whole-number-derived branch scores with a 24-hour label per decision.

        ``k`` is the number of onsets of the last seven days at the decision.
        """
        from .operators.joins import asof, event_counts

        d = event_counts(self.decisions, self.faults, ["entity"], "t", "t", {"k": 7 * DAY}, right_inclusive=False, until=self.bounds[1])
        d = asof(d, self.faults, ["entity"], "t", "t", {"next_onset": "t"}, inclusive=False, forward=True, until=self.bounds[0])
        label = F.when(F.col("next_onset") <= F.col("t") + DAY, 1).otherwise(0).cast("bigint")
        s1 = F.pmod(F.col("entity") * 37 + F.col("bin") * 101 + F.col("entity") * F.col("bin"), F.lit(997))
        s2 = F.pmod(F.col("entity") * 53 + F.col("bin") * 17 + F.col("k") * 211, F.lit(499))
        return d.select(
            "entity", "grp", "slot", "bin", "t", "k", label.alias("label"),
            ((s1 + F.lit(0.5)) / 997).alias("p1"), ((s2 + F.lit(0.5)) / 499).alias("p2"),
            idiv("bin", DAY // self.step).alias("origin"),
        )

    @cached_property
    def tape(self) -> DataFrame:
        """The score table written once, for plans that pass over it several times."""
        from .session import materialize

        return materialize(self.scores, "scores")

    @cached_property
    def jobs(self) -> DataFrame:
        """Job trace: submit = order date, start/end = first/last ship date."""
        item = self.table("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
            F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"), F.count("*").alias("gpu_num")
        )
        us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("CANCELLED")
        o = self.table("orders").select(
            F.col("o_orderkey").alias("job_id"), "o_custkey", "o_orderdate", "o_orderpriority",
            state.alias("state"), F.round(F.col("o_totalprice")).alias("gpu_time"),
        )
        return o.join(item, "job_id").select(
            "job_id",
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("submit_t"),
            us("s").alias("start_t"), us("e").alias("end_t"),
            ((us("e") - us("s")) / 1_000_000).alias("duration"),
            "gpu_time", "gpu_num", idiv(F.col("gpu_num") + 7, 8).alias("node_num"),
            (F.col("gpu_num") * 16).alias("cpu_num"),
            F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("user"), "state",
        )

    def sampled(self, df: DataFrame, seed: int, *keys: str) -> DataFrame:
        return df.withColumn("_h", mix_hash(seed, *keys))
