"""Seconds for the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. All rows
are computed (the ``noop`` sink takes them), nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from pyspark.sql import SparkSession

from framespan.queries import QUERIES

HEADLINE = [
    "q_levels_peak", "q_waveform_minmax", "q_loudness", "q_mask_or", "q_label_fold_back", "q_margin_chunks", "q_smooth_chunks", "q_clip_timeline",
    "q_range_override", "q_effect_dedupe", "q_stats", "q_cue_word_mask", "q_cue_retime", "q_dissolve_plan", "q_dissolve_lower_audio",
    "q_asof_keyframe", "q_motion", "q_smart_worthwhile", "q_point_in_interval", "q_mix_sum", "q_sidechain", "q_keyframe_sample", "q_session_gate", "q_v3_nested",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
