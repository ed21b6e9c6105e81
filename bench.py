"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayfold.plans import catalogue  # noqa: E402
from wayfold.session import local_session  # noqa: E402

HEADLINE = (
    "anchors_quantile",
    "graph_edges",
    "pooled_outcomes",
    "state_membership",
    "prefix_event_alignment",
    "adjacent_segments",
    "trial_coverage",
    "candidate_leaderboard",
    "junction_evidence",
    "cross_task_path_totals",
    "selected_paths",
    "shared_start_eligibility",
    "similar_history_classes",
    "selected_pairs",
    "explicit_mapping_lines",
    "batch_annotation",
    "catalog_relevance",
    "tolerant_compare",
    "graded_submissions",
    "geographic_daily_metrics",
    "acquisition_channel_cohorts",
    "streamed_trial_monitor",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="wayfold-bench")
    run(spark, "graph_nodes", folder)  # starts the JVM pools
    times = {name: run(spark, name, folder) for name in HEADLINE}
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
