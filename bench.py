"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from spanwise import registry
from spanwise.session import session

HEADLINE = [
    "q1", "q4_exists", "q6", "q8", "q12", "q14", "q17_correlated", "q19", "bj_block", "bj_block_hist", "bj_window", "bj_global_hist",
    "bj_date30", "bj_auto", "bk_granularity_ladder", "pl_sweep", "pl_copack", "pl_orientation_tail", "pl_true_recall", "f_flagship",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "4")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        registry.QUERIES[name](spark, sf_dir).collect()  # compiled code and file listings are warm, as in a long-lived session
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
