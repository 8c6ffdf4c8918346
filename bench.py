"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridtide.plans.catalog import QUERIES  # noqa: E402
from gridtide.session import local_session  # noqa: E402

HEADLINE = [
    "plant_tech_hourly", "subtype_pivot", "rollup_hour", "rollup_month", "cyclical_features", "local_datetime_dst",
    "multi_join_outer", "demand_generation_join", "source_validation", "completeness", "missing_clusters",
    "granularity_events", "expanding_unique", "chrono_split", "corr_matrix", "box_stats", "describe", "kde",
    "regional_mean", "level_mean", "wind_features", "periodogram", "acf", "stl_components", "mstl_components",
    "adf_test", "kpss_test", "ridge_metrics", "xgboost_metrics", "holt_winters", "arima",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors and the Python workers
    spark.range(8).mapInPandas(lambda frames: frames, "id bigint").count()
    names = sys.argv[1:] or HEADLINE
    timings = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
            },
        ),
    )


if __name__ == "__main__":
    main()
