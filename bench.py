"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import time

from txnspark.plans import catalog
from txnspark.session import build_session

HEADLINE = {
    "temporal_split_and_sampling": "agg_04_fraud_rate_per_split",
    "split_cutoffs_orders": "win_01_temporal_cutoffs",
    "exact_auc_ap_order_lines": "agg_08_roc_auc_order_lines",
    "heads_on_test_split": "flagship_heads_on_test_split",
    "prefix_sum_order_lines": "win_02_prefix_sum",
    "card_time_gap": "win_05_time_gap",
    "balanced_sample_order_lines": "smp_04_balanced_sample_order_lines",
    "fit_vocabulary": "tok_07_vocabulary",
    "tokenise_and_encode": "tok_08_encode",
    "ordinal_encoding": "mlx_01_ordinal_encoding",
    "pca_fit_and_transform": "mlx_02_pca_keeps_lengths",
    "external_scorer": "mlx_16_external_scorer",
    "train_three_heads_and_evaluate": "mlx_13_heads_side_by_side",
    "bundle_scoring": "mlx_11_test_scores",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    spark = build_session("bench", cores=cpus, shuffle=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.QUERIES, {}
    # Starts the JVM's code paths and the Python workers before anything is timed.
    queries["agg_05_class_balance"](spark, folder).collect()
    queries["udf_02_scoring_function"](spark, folder).write.format("noop").mode(
        "overwrite").save()
    for label, name in HEADLINE.items():
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
