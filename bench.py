"""Headline plans, timed one by one; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores)
select the data and the parallelism. Each plan runs to a no-op sink after a session
warm-up; the time is the median of BENCH_REPEAT runs (default 3, fewer for a plan that
has used up BENCH_PLAN_SECONDS, default 6). "large" holds rows, seconds and rows per
second of the 45-column features on a grid with every entity BENCH_COPIES times
(default 30: 5.4 million rows at sf0.1).
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession, functions as F

from faultscope.canonical import Canon
from faultscope.operators import features
from faultscope.plans import catalog

HEADLINE = [
    "episodes_by_code", "episode_ledger", "event_index", "interval_union", "recording_gaps", "bin_means", "dense_grid", "lag_window_short",
    "lag_window_long", "peer_stats_null_aware", "features_basic30", "features_peer45_integrated", "features_history5", "features_hazard11",
    "features_dense132", "asof_last_onset", "label_state", "multi_head_labels", "history_counts", "event_window_features", "control_candidates",
    "topk_per_time", "topk_churn", "swap_tail", "ap_auc_pooled", "ap_auc_by_origin", "recall_ndcg_at_k", "onset_capture", "ema_memory",
    "inertia_scores", "negative_sampling", "daily_jobs", "job_tape", "numeric_describe", "risk_tape",
]
#: A training, a streaming, a matching and a bootstrap plan, run once; not in the headline total.
MORE = ["logistic_optimum", "stream_ledger", "matched_effects", "bootstrap_median"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    most = float(os.environ.get("BENCH_PLAN_SECONDS", "6"))
    copies = int(os.environ.get("BENCH_COPIES", "30"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(cpus, 4)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Small inputs: keep all cores busy in compute-heavy window stages.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.PLANS["fault_code_summary"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    out = {}
    for name in names:
        times = []
        while len(times) < repeat and (not times or sum(times) < most):
            t0 = time.perf_counter()
            catalog.PLANS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    more = {}
    for name in MORE if not sys.argv[1:] else []:
        t0 = time.perf_counter()
        catalog.PLANS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        more[name] = round(time.perf_counter() - t0, 3)
    large = {}
    if copies > 1 and not sys.argv[1:]:
        c = Canon(spark, sf_dir, copies=copies)
        n = c.first_last[1] - c.first_last[0] + 1
        rows = c.table("events").agg(F.count_distinct("user_id")).first()[0] * copies * n
        t0 = time.perf_counter()
        features.peer45(c.grid, 12, hours=72.0, colocate=True).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - t0
        large = {"plan": "features_peer45", "grid_rows": rows, "seconds": round(seconds, 1), "rows_per_second": round(rows / seconds)}
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "more": more, "large": large}))
    spark.stop()


if __name__ == "__main__":
    main()
