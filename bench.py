"""Time the headline queries; prints one line of JSON.

The warehouse tables are first stored as Parquet, as they would be in use; that load is
reported as ``load_seconds`` and is not part of the total. Each query then runs over
the whole stored tables into a sink that takes every row and column.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores,
``BENCH_QUERIES`` (comma separated) other queries to time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from depotflow.catalog import QUERIES
from depotflow.session import fresh_path, local_session
from depotflow.sources.star import StarWarehouse

HEADLINE = [
    "stock_status", "low_stock_alerts", "purchase_order_full", "grn_full", "sales_order_full",
    "delivery_challan_full", "admin_dashboard", "unique_key", "foreign_key", "add_lines",
    "confirm_grn", "confirm_grn_stock", "reserve_stock", "reserve_stock_balance", "dispatch_dc",
    "cancel_so", "advance_so", "stock_ledger_stream", "status_transitions", "copy_text_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    start = time.perf_counter()
    warehouse = StarWarehouse(spark, sf_dir).loaded(fresh_path(spark, "warehouse"))
    load_seconds = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].build(warehouse).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "load_seconds": load_seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
