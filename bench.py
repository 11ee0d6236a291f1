"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then is timed; the result goes to a sink that
drops the rows, so the whole result is computed and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "filter_pushdown", "step_multiply", "join_inner", "join_outer", "join_suffixes", "join_hot_key",
    "group_aggregate_basic", "group_aggregate_first_last", "dedup_first", "dedup_subset", "duplicate_id_members", "ffill", "sort_rank_nulls_last",
    "fill_median", "column_stats_lineitem", "column_profile", "top_values", "diff_ks", "anomalies", "audit_cells",
    "issues_report", "clean_auto", "clean_smart", "clean_layers_full", "scenario_result", "scenario_anomalies",
    "catalog_and", "usage_remaining",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for timed in (False, True):
            spark.catalog.clearCache()
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": folder}))


if __name__ == "__main__":
    main()
