"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "rul1_line_cross", "rul2_intrusion", "rul3_dwell", "rul4_absence", "rul5_crowd", "rul8_speed",
    "sup1_top_k_per_frame", "sup2_class_nms", "sup4_rotated_nms", "agg1_detection_stats",
    "evt4_attach_review", "agg5_timeline_counts", "alr1_alert_throttle", "evl4_oriented_ap", "evl1_box_ap",
    "dst4_clip_to_tiles", "dep2_box_distance", "pos1_skeleton_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.chdir(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, os.getcwd())
    from framelens.session import local_session
    from framelens.workload import QUERIES
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executors
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
