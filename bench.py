"""Time the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores, ``BENCH_QUERIES`` (comma-separated, or "all") the
queries. Each query is planned and run to the end, every row computed, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotledger.plans.catalog import QUERIES
from slotledger.session import local_session

HEADLINE = (
    "summary_month",
    "summary_year",
    "daily_week",
    "weekly_agg",
    "monthly_agg_year",
    "util_shift",
    "presence_days",
    "presence_matrix_month",
    "attainment_month",
    "bookings_flatten",
    "day_grid",
    "booking_outcomes",
    "bookings_settled",
    "occupancy_intervals",
    "booking_outcomes_stream",
    "util_shift_live",
    "change_feed",
    "client_state",
    "config_effective",
    "employees_current",
    "employee_target_asof",
    "feedback_current",
    "feedback_count_feed",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery before the clock runs.
    QUERIES["summary_week"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(cores).repartition(cores).mapInArrow(lambda batches: batches, "id bigint").count()
    timings = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
