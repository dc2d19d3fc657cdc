"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from orderlines.functions.storage import release  # noqa: E402
from orderlines.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "a1_order_rollup",
    "a2_overview",
    "a5_product_ranking",
    "a6_category_breakdown",
    "a8_platform_comparison",
    "a9_daily_trend",
    "a10_daily_features",
    "a12_hourly_heatmap",
    "a13_customer_profiles",
    "p6_dedup",
    "p11_clean_lines",
    "q1_order_outliers",
    "q3_quality_report",
    "q4_profile",
    "f3_segments",
    "f5_segment_distribution",
    "m2_itemsets",
    "m4_top_rules",
    "m5_pair_rules",
    "c2_clusters",
    "t3_forecast",
    "d1_order_features",
    "d2_isolation_forest",
    "r1_kpi_verdicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orderlines-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # Intermediates are written, as on a cluster; here driver and executors are one machine.
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="orderlines-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for table in ("lineitem", "orders", "part", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "orderlines_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
