"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shopledger.queries.catalog import all_queries
from shopledger.session import local_session

HEADLINE = [
    "mrt01_transactions", "mrt02_monthly_dashboard", "mrt03_store", "mrt04_whole_period_kpi", "mrt08_customer_kpi", "mrt09_rfm", "mrt10_purchase_gap_profile", "mrt11_customer_month",
    "mrt14_churn_training_set", "mrt16_lifetime_value_set", "mrt19_promotions", "mrt22_store_profit", "mrt25_general_ledger", "mrt28_scaled_tender_split", "mrt33_price_history", "mrt36_inventory_metrics",
    "mrt49_dense_product_weeks", "ml01_pair_counts", "ml02_pair_scores", "ml06_slope_through_origin", "ml10_robust_z", "agg10_exact_median", "win05_global_ntile", "jn08_lookback_180",
    "sem03_metric_by_grain", "web02_flattened_pages", "lin01_source_tables", "str01_live_alert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=max(8, int(cores) if cores.isdigit() else 8))
    registered = all_queries()
    chosen = sys.argv[1:] or HEADLINE
    registered["srt02_bottom_products"].build(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        registered[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    label = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(label) if label.replace(".", "").isdigit() else label}))
    spark.stop()


if __name__ == "__main__":
    main()
