"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores; names on the command line choose queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyledger.plans.catalog import QUERIES  # noqa: E402
from skyledger.session import local_session  # noqa: E402

HEADLINE = (
    "base_panel",
    "rain_anomaly",
    "drought_category",
    "extreme_categories",
    "streaks",
    "district_comparison",
    "period_trend_week",
    "top_hottest",
    "spearman",
    "import_validate",
    "payload_explode",
    "upsert_forecast",
    "grid_nearest",
    "nearest_supplier",
    "history_fallback",
    "projections",
    "hotspot_ranking",
    "rank_movement",
    "classification_metrics",
    "train_classifiers",
    "batch_score",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores, app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        # Every row is produced; nothing is kept.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_headline_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
