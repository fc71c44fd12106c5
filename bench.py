"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs once untimed and then ``BENCH_RUNS`` times (3); the medians count. ``build`` is the part of each
median run that was spent before the result was asked for, in jobs that the operators start themselves.
"""

from __future__ import annotations

import gc
import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stratalens.plans.catalog import QUERIES  # noqa: E402
from stratalens.session import build_session  # noqa: E402

HEADLINE = [
    "scorecard_full_overall",
    "match_country_segment",
    "strategic_detail",
    "weighted_reliability",
    "top_contributors",
    "fix_summary",
    "cumulative_gaps",
    "simplify_coverage",
    "simplify_auto",
    "allocation_sizes",
    "efficiency_gain",
    "size_curve",
    "replicate_statistics",
    "subsample_stability",
    "within_variance",
    "variance_cross_survey",
    "variance_summary",
    "map_lenient",
    "unpivot_benchmark",
    "rollup_region",
    "wave_trend",
    "compare_pivot",
    "alignment_report",
    "validate_survey_deep",
    "profile_columns",
    "windowed_match",
    "cumulative_match",
    "stream_snapshot",
]


def run(name: str, spark, sf_dir: str) -> tuple[float, float]:
    """Seconds in all, and of those until the frame was built."""
    start = time.perf_counter()
    frame = QUERIES[name](spark, sf_dir)
    built = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, built - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        app="stratalens-bench",
        spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "6g"),
        spark_checkpoint_dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, build = {}, {}
    for name in HEADLINE:
        run(name, spark, sf_dir)  # compiles the plan's code and warms the file cache
        timed = sorted(run(name, spark, sf_dir) for _ in range(runs))
        seconds[name], build[name] = (round(x, 3) for x in timed[len(timed) // 2])
        gc.collect()  # frames that are gone let Spark remove their checkpoints
    line = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "build": build,
        "median_query": round(statistics.median(seconds.values()), 3),
        "runs": runs,
        "sf": float(Path(sf_dir).name.removeprefix("sf")),
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
