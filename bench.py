"""Benchmark: wall time of the headline query keys.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run once to warm up (JIT, file listing) and then timed
once with a full materialisation (the cache is cleared first, so blocks
persisted by the warm-up run are not reused) (``write`` to the ``noop`` sink, so no
rows travel to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsift.plans.queries import QUERIES  # noqa: E402
from logsift.session import build_session  # noqa: E402

HEADLINE = [
    "session_summary", "filter_stats", "classify_lines", "session_errors", "byte_cap",
    "collapse_runs", "resolve_summary", "session_rollup", "events_page", "agent_timeline",
    "timeline_digest", "timeline_summary", "file_history", "recent_alerts", "unseen_alerts",
    "command_audit", "path_audit", "result_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": "16g"})
    times = {}
    for k in keys:
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()  # no persisted blocks carry over into the timed run
        t0 = time.perf_counter()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time_headline_queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
