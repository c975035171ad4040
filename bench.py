"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerloom.plans.catalog import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "ledger_daily", "runway_point", "asof_receivables", "delay_empirical_summary", "delay_spearman", "credit_features", "auc_rule_score", "calibration_quantile",
    "conformal_forecast", "runway_at_risk", "exact_allocation", "regret_metrics", "statement_reconcile", "amount_cells", "robust_z", "duplicate_band_join",
    "text_category", "receipt_rows", "hash_chain_verify", "stream_daily_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["asof_receivables"](spark, sf_dir).limit(1).collect()  # start the JVM and code generation
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
