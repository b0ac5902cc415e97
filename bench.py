"""Times the headline queries and prints one JSON line. Each query runs once to warm up and once for the clock, with
its whole result computed and thrown away."""

from __future__ import annotations

import json
import os
import time

from tidemark.queries import QUERIES
from tidemark.session import get_session

HEADLINE = (
    "point_lookup", "range_filter_supplier", "scan_filter_conj", "sum_by_key", "agg_group_two", "agg_having", "join_3way_range", "join_3way_composite", "join_order_by", "join_mixed", "join_correlated_5way",
    "join_derived_min", "join_merge", "flagship", "flagship_order_agg", "sort_multi_dir", "bulk_group", "dml_update",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
