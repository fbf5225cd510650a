"""Benchmark the headline report queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default all cores) and prints ONE JSON line:
{"metric": "sum_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.

Each query is executed to completion with a ``noop`` write (no collect), in
a warm session, ``$BENCH_RUNS`` times (default 3); the median is reported.
The base purchases are staged once per session (timed as ``stage_base``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "monitoring_headline", "monitoring_monthly", "dimension_breakdown", "monitoring_alerts",
    "quality_report", "quality_problems", "quality_examples",
    "recommendations", "dimension_trends", "savings_opportunities", "executive_summary",
    "feature_frame", "projection_headline", "projection_monthly", "seasonal_forecast",
    "anomaly_report", "context_projection", "isolation_scores",
    "amount_quartiles", "extract_stat_cards",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    n_cores = os.cpu_count() if cpus == "*" else int(cpus)
    from spendlens.session import local_session
    from spendlens.suite import spark_queries
    from spendlens.suite.core import base

    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * n_cores), app="spendlens-bench")
    qs = spark_queries()
    t0 = time.perf_counter()
    base(spark, sf_dir).write.format("noop").mode("overwrite").save()
    stage = time.perf_counter() - t0

    timings: dict[str, float] = {}
    for key in HEADLINE:
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t)
        timings[key] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_median_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": m.group(1) if m else sf_dir,
        "cpus": n_cores,
        "runs": runs,
        "stage_base_sec": round(stage, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
