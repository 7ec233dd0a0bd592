"""Times the headline queries; prints one JSON line.

One run of the first query warms up the JVM; then each query runs once for the
clock, with its result written to Spark's no-op sink, so every row is produced
and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from footmark.plans.queries import QUERIES  # noqa: E402
from footmark.session import local_session  # noqa: E402

HEADLINE = [
    "platform_usage", "visits_by_platform", "downloads_by_platform", "content_remnants", "unified_log_hits", "hit_counts",
    "hit_offsets", "first_rule_hits", "export_replay", "all_links", "final_confidence", "episode_levels", "artifact_claims",
    "case_timeline", "comparison_matrix", "exhibits", "image_findings", "event_exhibits", "case_totals", "requirement_status",
    "tool_checklist", "history_gaps",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    names = sys.argv[1:] or HEADLINE
    times = {}
    seconds(spark, names[0], sf_dir)
    for name in names:
        times[name] = round(seconds(spark, name, sf_dir), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
