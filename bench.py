"""Benchmark: run the headline cards at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each card is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver), from Parquet every time: the
cache is cleared before each run.  ``value`` is the sum of the
per-card median times over $BENCH_RUNS runs (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "rfm_report",
    "rfm_thresholds",
    "ltv",
    "seasonality_index",
    "segment_revenue_share",
    "cohort_retention",
    "churn_rate",
    "churn_risk_segment",
    "avg_spend_by_segment",
    "registrations_daily",
    "registrations_monthly",
    "weekly_retention_cohorts",
    "attribution_fill",
    "param_event_counts",
    "param_funnel",
]


def main() -> None:
    from segmenta.plans.cards import CARDS
    from segmenta.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    keys = only or HEADLINE

    spark = get_spark(
        f"local[{cpus}]",
        app_name="segmenta-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Warm-up (not timed): JVM class loading, JIT compilation of the hot loops
    # and Spark code generation.  The JIT needs a couple of full-size runs, so
    # the warm-up runs a few cards covering every operator family at the bench
    # scale.  The cache is cleared before every timed run, so no timed run
    # reads data materialised by the warm-up or by another run.
    warm = os.environ.get("BENCH_WARMUP", "rfm_report,param_funnel")
    for key in [k for k in warm.split(",") if k]:
        spark.catalog.clearCache()
        CARDS[key](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for key in keys:
        samples = []
        for _ in range(runs):
            # Cards persist their intermediates; drop every cached block first so
            # no run reads data an earlier run materialised.
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            CARDS[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(
        json.dumps(
            {
                "metric": "sum_of_card_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
