"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to a no-op sink, so all rows and columns are computed. The
value is the sum of the times.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cadenza.plans import all_queries  # noqa: E402
from cadenza.session import build_session  # noqa: E402

HEADLINE = [
    "a05_suppressed_trigger_counts", "a09_usage_range_merge", "j08_curve_value_at_event", "j09_segment_at_time", "j11_sync_score",
    "w01_moving_average", "w02_savgol_smoothing", "w05_peaks_by_distance_and_prominence", "w15_timeline_layout", "w20_rule_walk",
    "s01_catalog_scan", "f01_composite_clip_filter", "a01_analysis_statistics", "a03_exact_duplicate_groups", "a07_usage_upsert_mean",
    "j07_relocation", "j16_top_clips_by_motion", "m01_mood_score_of_pairs", "m10_nearest_energy_motion", "v02_exact_neighbours",
    "v04_similar_clips", "v10_near_duplicate_groups", "v11_content_fingerprint", "c03_mood_labels", "a15_frame_label_summary",
    "a20_motion_summary", "s10_zoom_keyframes", "x11_size_bounded_eviction",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
