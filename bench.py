"""Benchmark the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 3; median reported after one
warm-up).  Each query is fully executed through the ``noop`` sink, so the
time covers the whole plan without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import subprocess
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "features_batch", "features_online", "scaler_fit", "score_rows", "alerts_append",
    "tx_stats", "tx_status_counts", "tx_page", "tx_flagged", "tx_filtered",
    "tx_bulk_review", "tx_upsert", "ingress_validate", "msg_validate", "pipeline_counters",
    "eval_report", "eval_auc", "eval_sweep", "eval_job_confusion",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    from txguard.plans.registry import load_all
    from txguard.session import local_session
    parts = 2 * cpus
    spark = local_session(cores=cpus, shuffle_partitions=parts, app="txguard-bench", driver_memory="16g")
    reg = load_all()
    times = {}
    for name in names:
        q = reg[name]
        q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()      # warm-up
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(ts), 3)
    try:
        rev = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True,
                             cwd=os.path.dirname(os.path.abspath(__file__))).stdout.strip()
    except OSError:
        rev = ""
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "shuffle_partitions": parts, "runs": runs, "git": rev}))
    spark.stop()


if __name__ == "__main__":
    main()
