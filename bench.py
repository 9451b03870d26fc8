"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

bench.py [--quick] [--records DIR] [NAME...]: of these queries only; with --quick once each, on the
smaller tables; with --records each one's times also as a JSON record, in DIR.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from sparelane.operators.bench_records import record
from sparelane.plans import catalog
from sparelane.sources.records import write_records

#: Mechanisms beside their baselines, and the scans and joins under them.
QUERIES = [
    "fact_naive", "fact_sum", "fact_incr", "rank_brute", "rank_lookup", "rank_certified", "region_materialized", "region_sum",
    "prog_filter", "block_filter", "cert_intersect", "cert_sparse", "cert_disjoint", "tri_binary", "tri_neighbors",
    "quota_global", "quota_sharded", "coded_sum", "pgm_lookup", "key_lookup", "scan_filter_agg", "lookup_batch",
    "range_rescan", "range_shared", "joint_brute", "joint_winner", "corr_filter", "corr_prune", "corr_implied",
    "fact_stored", "rank_stored", "rank_held", "region_stored", "range_stored", "corr_stored", "pgm_stored",
]
#: (baseline, mechanism): their ratio is what can be compared across engines.
RATIOS = [("fact_naive", "fact_stored"), ("rank_brute", "rank_stored"), ("rank_brute", "rank_held"), ("range_rescan", "range_stored"), ("corr_filter", "corr_stored"), ("key_lookup", "pgm_stored"), ("fact_naive", "fact_sum"), ("rank_brute", "rank_lookup"), ("joint_brute", "joint_winner"), ("tri_binary", "tri_neighbors"), ("range_rescan", "range_shared"), ("cert_intersect", "cert_disjoint"), ("corr_filter", "corr_prune")]


def main() -> None:
    asked = argparse.ArgumentParser()
    asked.add_argument("--quick", action="store_true")
    asked.add_argument("--records")
    asked.add_argument("names", nargs="*")
    args = asked.parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01" if args.quick else "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, built, records = catalog.queries(), {}, {}, None
    for name in args.names or QUERIES:
        runs = []
        for _ in range(1 if args.quick else 2):  # the first run also compiles, and builds what *_stored and *_held ask
            began = time.perf_counter_ns()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter_ns() - began)
        first, best = runs[0] / 1e9, min(runs) / 1e9
        times[name] = round(best, 3)
        if args.records:
            one = record(spark, name.split("_")[0], name, 1, json.dumps({"tables": sf_dir}), runs, 1, 0)
            records = one if records is None else records.unionByName(one)
        if name.endswith(("_stored", "_held")):
            built[name] = round(first - best, 3)
    if records is not None:
        write_records(records, args.records)
    ratios = {f"{a}/{b}": round(times[a] / times[b], 2) for a, b in RATIOS if a in times and b in times}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_less_best": built, "ratios": ratios, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
