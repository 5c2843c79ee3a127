"""Time the headline queries over one folder of tables and print one JSON line.

Every query starts from the source tables: shared intermediate tables and caches are dropped
before each timing. One small warm-up run compiles the generated code first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from driftpanel.plans.catalog import QUERIES  # noqa: E402
from driftpanel.plans.context import forget_contexts  # noqa: E402

HEADLINE = (
    "orders_ag6_manifest",
    "orders_ag2_event_sessions",
    "orders_ag5_abnormality",
    "orders_wn1_prefix",
    "orders_wn6_split",
    "orders_ag10_scaler",
    "orders_hm8_viterbi",
    "orders_ag12_occupancy",
    "orders_hm13_forecast",
    "orders_st1_roc_auc",
    "orders_st4_spearman",
    "ag2_event_sessions",
    "ag12_occupancy",
    "hm4_expectation",
    "hm6_fit",
    "hm10_select_state_count",
    "st6_order_test",
    "st7_forecast_bootstrap",
    "st12_leave_one_arm_out",
    "st15_elastic_net_baseline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftpanel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        spark.catalog.clearCache()
        forget_contexts()
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in ("orders_ag12_occupancy", "hm6_fit"):
        run(name, sf_dir)
    seconds = {name: round(run(name, sf_dir), 3) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
