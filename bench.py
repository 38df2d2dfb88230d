"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, and ``BENCH_QUERIES``
a comma list of other queries ("all" for every registered one).  Each query runs
twice in full, without collecting rows, and its better time counts.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import QUERIES
from tidemark.session import build_session

HEADLINE = [
    "tumbling_count", "hopping_latest", "latest_by_offset", "changelog_count", "dedup_windowed",
    "compact_tombstone", "repartition_keys", "within_join", "join_latest", "join_asof_left",
    "join_asof_event_time", "fillna_earliest", "missing_ids", "duplicate_report", "reconcile_counts",
    "late_rows", "topic_encode", "json_flatten", "schema_evolve",
    "poll_ts_inc", "poll_batches", "cdc_apply", "topk_multi", "date_sharded_union", "sink_roundtrip",
    "stream_tumbling_count", "stream_within_join", "stream_join_asof",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
