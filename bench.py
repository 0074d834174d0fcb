"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  Each query runs once to warm up (but
the whole audit, which comes last) and is then timed; the result is consumed by the no-op sink, so every row is produced.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.plans.workload import QUERIES  # noqa: E402

HEADLINE = [
    "feature_audit", "missing_values", "near_constant", "duplicates", "skewness", "high_correlation", "target_leakage",
    "iqr_outliers", "iqr_outliers_lineitem", "multivariate_outliers", "issue_summary", "split_hash", "split_stratified",
    "row_overlap", "psi_table", "variance_ratio", "feature_stability", "informative_missingness", "vif", "impute",
    "robust_scale", "one_hot", "preprocess", "classification_metrics", "roc_auc", "calibration_curve",
    "deployment_readiness", "deployability_score", "recommendations", "issues_by_type", "correlation_matrix",
    "rf_classify", "csv_scan", "audit_report",
]
# By its turn the engine is warm, and it runs most of the others again.
ONCE = {"audit_report"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(max(int(cpus) if cpus.isdigit() else 8, 4)))
             .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        for _ in range(1 if name in ONCE else 2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
