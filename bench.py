"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "w1_stream_boundaries",
    "f5_local_peaks",
    "f7_offline_gap",
    "f8_frame_events",
    "f5_live_changes",
    "f14_detector_replay",
    "j2_collar_match",
    "a5_threshold_sweep",
    "a6_best_threshold",
    "a7_average_precision",
    "a8_auroc",
    "a10_event_sweep",
    "a17_full_report",
    "u1_threshold_split",
    "u8_window_specs",
    "w3_running_offsets",
    "k4_sessions",
    "k5_line_endpoints",
    "k5_stream_lines",
    "k8_final_lines",
    "t5_formatted_documents",
    "t7_caption_chunks",
    "g2_normalised",
    "g10_reverb_mix",
]


def main() -> None:
    from segflow.plans import all_queries
    from segflow.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    result = {
        "metric": "headline queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
