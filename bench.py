"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ledgerloom.session import build_session, release_staged
from workload.queries import QUERIES

HEADLINE = (
    "orders_enriched", "fct_orders", "fct_order_items", "dim_customers", "zip_centroids",
    "monthly_performance", "category_performance", "state_performance", "payment_performance", "customer_segments",
    "frequency_distribution", "distributed_ntile", "global_positions",
    "grain_probe_lines", "fanout_report", "money_survives", "metric_layer_reconciles", "extract_reconciliation",
    "overview", "state_view", "lead_features_table", "prior_counts_agree", "ranking_quality", "cumulative_gains",
    "experiment_readout", "covariate_balance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g", spark__python__sql__dataFrameDebugging__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # the session is up before the clock starts
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release_staged(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
