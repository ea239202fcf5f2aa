"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HEADLINE = (
    "flagship_monthly_prevalence", "a10_person_table_sink", "c13_feature_table", "d02_median_by_worker_large",
    "d03_homevisit_rate", "d07_person_month_cohort", "d16_feature_report", "d35_age_by_tier", "e01_latest_visit_per_month",
    "e03_latest_registry_per_area", "e07_registry_record_rank", "e10_prior_events", "e11_trailing_activity",
    "f02_top_k_threshold", "f04_ranked_risk_list", "h24_dose_completeness", "i12_roc_auc_many", "i16_expected_calibration_error",
    "i19_threshold_table_16", "i20_group_fairness", "i26_psi_drift",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from fieldtally.catalog import QUERIES
    from fieldtally.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="fieldtally-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's code paths.
    QUERIES["d14_scoring_monitor"](spark, folder).collect()
    took = {}
    for name in HEADLINE:
        at = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - at, 3)
    print(json.dumps({"metric": "headline queries, wall-clock total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
