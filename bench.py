"""Time the headline queries; prints one JSON line.

Every result is computed in full and written to Spark's no-op sink.  The first
query pays for starting the session, so a scan is done before the clock starts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from veilwork.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Query -> table whose rows it masks or reads.
HEADLINE = {
    "mask_customer_full": "customer",
    "src_filter_mask": "orders",
    "gen_hash_by_value": "lineitem",
    "gen_counter": "orders",
    "gen_template": "customer",
    "src_view_mask": "orders",
    "update_join": "orders",
    "incremental_orders": "orders",
    "full_diff": "orders",
    "uniq_short_text": "orders",
    "uniq_phone_customer": "customer",
    "stream_mask_events": "events",
    "discover_keys": "lineitem",
    "verify_untouched": "customer",
    "preview_diff": "customer",
    "preflight_issues": "customer",
    "fk_cycles": "lineitem",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(HEADLINE.values())}
    QUERIES["gen_hash"](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {n: int(rows[t] / seconds[n]) for n, t in HEADLINE.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
