"""Headline queries on the driver's tables: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from fieldlake import registry  # noqa: E402
from fieldlake.session import build  # noqa: E402

HEADLINE = (
    "bucket_stats_detections_hour", "bucket_stats_gps_day", "environment_summary", "risk_summary", "summary_cards",
    "historical_environment_linear", "rolling_mean", "hampel", "stress_flags", "debounce_events", "suppress_alerts", "momentum",
    "track_segments", "radius_join", "zone_multiplier", "crossings", "grid_clusters", "home_range", "allele_frequencies",
    "rarefied_richness", "temporal_ne", "population_metrics", "validate_edna_batch", "threat_subscore", "fan_out", "speed_verdicts",
    "zone_radar",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
                                                    "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="fieldlake-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.load().QUERIES
    queries["table_profile"](spark, folder).collect()  # start the JVM's caches
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # the whole result is produced and thrown away, so nothing is pruned and nothing is collected
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": pathlib.Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
