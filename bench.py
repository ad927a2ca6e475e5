"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "differential_photometry", "quality_score", "variability_metrics", "reference_stars", "crossmatch_bands", "unique_match", "deck_stats",
    "observation_orbit", "lomb_scargle", "event_forecast", "aperture_photometry", "master_frames", "tracked_stack", "tracklet_seeds",
    "transient_groups", "submission_rows",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from skyloom.plans.registry import all_queries

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    queries["timing_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the workers
    times = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
