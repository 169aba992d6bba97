"""Time the headline queries; prints one JSON line.

Each query is built and written to a no-op sink, so every row and column is
computed and nothing is collected.  One warm-up query starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from exprstudy.plans import queries as catalogue  # noqa: E402
from exprstudy.session import local_session  # noqa: E402

HEADLINE = (
    "melt_matrix",
    "matrix_blocks",
    "quality_scan",
    "cohort_summary",
    "cohort_dedup",
    "audit_counters_lines",
    "audit_quantiles",
    "stratified_holdout_orders",
    "stratified_folds",
    "anova_f_lines",
    "standardize_fold",
    "robust_scale_fold",
    "select_k_best",
    "budget_features",
    "overall_metrics",
    "ovr_auc",
    "matrix_digest",
    "lines_digest",
    "candidate_ranking",
    "run_speedup",
    "cv_logistic_l2",
    "cv_elastic_net",
    "cv_linear_svm",
    "budget_study",
    "cv_pca_logistic",
    "final_holdout_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("exprstudy-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.REGISTRY["class_weights_lines"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalogue.REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(folder))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
