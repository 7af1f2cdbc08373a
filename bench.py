"""Times headline queries on local Spark and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores. Building a
query counts, since some store small intermediate tables; each is run once after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from pairgauge.plans.queries import QUERIES
from pairgauge.session import local_session

HEADLINE = (
    "load_summary contract_checks characterize_grouped audit_duplicates conflicting_rows "
    "predictor_overlap stratified_kfold impute_stats scaler_stats matrix_guard work_list "
    "balanced_accuracy roc_auc_exact trial_means meta_table recommend_dummy_lofo admission_ledger"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus)
    QUERIES["class_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
