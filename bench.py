"""Time the headline reports: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from spindlewise.contract.queries import QUERIES
from spindlewise.session import local_session

HEADLINE = [
    "afr_quarterly",
    "afr_enriched",
    "afr_cumulative",
    "afr_wide",
    "drives_deployed_qtr",
    "drives_removed_qtr",
    "model_date_ranges",
    "models_per_mfr",
    "deployments_subtotals",
    "distribution_totals",
    "capacity_fleet",
    "capacity_dc_report",
    "capacity_by_mfr",
    "dim_drive_models",
    "dim_drives",
    "snapshot_dates_qtr",
    "snapshot_dates_qtr_stream",
]


def seconds(query, spark, folder) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    timings = {}
    for name in HEADLINE:
        seconds(QUERIES[name], spark, folder)  # generated code is compiled in the first run
        timings[name] = round(seconds(QUERIES[name], spark, folder), 3)
    print(
        json.dumps(
            {
                "metric": "headline reports, second run, total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
