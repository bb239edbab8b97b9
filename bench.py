"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs per
query (the best counts; one run before them warms up the session). Every result is written to the
noop sink, so all rows and columns are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from mirrorkit.queries import QUERIES
from mirrorkit.session import configure, shared_dir

HEADLINE = (
    "ingest_plan", "run_summary", "membership_diff_key", "membership_diff_uid", "dest_guard", "ledger_antijoin",
    "route_bucket", "tags_per_key", "gate_ops", "apply_moves", "apply_tag_deltas", "dest_current", "backfill_plan",
    "audit_report", "first_per_key", "dedup_key", "document_keys", "parse_headers", "op_sequence",
)


# Whole passes and streams, timed once each; they are not part of the headline total.
PASSES = ("reconcile_pass", "reconcile_missing_bodies", "stream_dedup", "stream_members")


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("mirrorkit-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return configure(spark)


def timed(spark: SparkSession, name: str, sf_dir: str, runs: int, warm: bool = True) -> float:
    def once() -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    if warm:
        once()
    return min(once() for _ in range(runs))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cpus)
    times = {}
    for name in HEADLINE:
        times[name] = round(timed(spark, name, sf_dir, runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    for name in PASSES:
        times[name] = round(timed(spark, name, sf_dir, 1, warm=False), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": total, "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
