"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import plans  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "day_fold", "rolling_z", "rolling_quantile", "rolling_ref_floor", "scores_subject_z", "scores_subject_pct", "robust_z_group", "deviation_signed", "facts_crossfit", "rule_evidence", "apply_explanation",
    "crossfit_explanation", "alerts_k", "alert_eval", "k_sweep", "asof_span", "overlap_label", "nearest_event", "sliding_windows", "purity_windows", "auc_pooled", "spearman", "array_time_hrv", "service_baseline_14d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    plans.QUERIES["day_fold"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session and its code cache
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs):
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "runs": runs, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
