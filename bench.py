"""Headline-query benchmark.

Runs the headline queries of the registry on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced end to end with the ``noop`` sink (full execution, no
collect to the driver). A short warm-up on the smallest scale is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b14_clean_chain",
    "c01_describe",
    "c05_correlation",
    "c07_outliers",
    "c08_outcome_rate",
    "c10_histogram",
    "d12_stratified_split",
    "d17_feature_chain",
    "d14_smote",
    "e23_threshold_sweep",
    "e26_roc_auc",
    "e04_logistic_regression",
    "f02_batch_probability",
    "f08_score_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in sys.argv[1:] if not q.startswith("-")]
    from lendscope.session import get_spark
    from lendscope.plans.registry import QUERIES

    spark = get_spark(f"local[{cpus}]", app="lendscope-bench",
                      **{"spark.sql.shuffle.partitions": str(max(8, int(cpus)))})
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        QUERIES["c08_outcome_rate"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
