"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores). Every query runs
once to warm up and once for the clock; all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chartspark.plans import QUERIES  # noqa: E402
from chartspark.session import local_session  # noqa: E402

HEADLINE = [
    "agg1_accuracy_by_type", "agg2_chart_answer_counts", "agg3_model_accuracy_per_chart", "agg4_question_accuracy",
    "agg7_facets", "agg9_dataset_rollup", "agg14_iterations", "agg15_numeric_profile", "bundle_chart_index",
    "cht2_bar", "cht4_line_filled", "cht6_histogram", "cht7_hist2d", "cht8_hexbin", "cht10_correlation",
    "cht12_box_stats", "cht13_density", "cht14_ecdf", "cht17_sample_points", "cht19_residuals", "cht24_hierarchy",
    "cht28_bump", "cht29_waterfall", "cht30_funnel", "cht39_transform", "flt2_search", "joi1_results_of_known_charts",
    "joi3_questions_with_answers", "joi5_resolve_images", "joi8_scored_matches", "prj7_family_of_text",
    "prj25_meaningful_tokens", "score12_accuracy", "srt1_sorted_charts", "srt4_seeded_shuffle", "src1_strict_jsonl",
    "str1_live_accuracy", "win2_prefix_blocks", "win4_running_usage",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, sf)
        times[name] = round(run(spark, name, sf), 3)
    spark.stop()
    scale = Path(sf).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
