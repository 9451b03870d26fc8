"""Summaries and comparisons of benchmark records."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The pairs (experiment, before, after) that a report compares.
PAIRS = [
    ("factorized", "naive_pairs", "factorized_sums"),
    ("factorized", "hashjoin_then_pairs", "incremental_insert_a"),
    ("answer_cells", "brute_scan_pareto", "cell_lookup_pareto"),
    ("answer_cells", "brute_scan_random", "cell_lookup_random"),
    ("answer_cells", "brute_scan_near_tie", "cell_lookup_near_tie"),
    ("executable_regions", "materialized_bulk_add", "compact_bulk_add"),
    ("executable_regions", "materialized_point_lookup_4k", "compact_point_lookup_4k"),
    ("progressive", "full_scan_clustered", "block_bounds_clustered"),
    ("progressive", "full_scan_spread", "block_bounds_spread"),
    ("shared_state", "rescan_each_query", "shared_index_counts"),
    ("certificate", "merge_disjoint_range", "bound_certificate_disjoint"),
    ("certificate", "merge_sparse", "gallop_sparse"),
    ("certificate", "merge_overlap", "gallop_overlap"),
    ("redundancy", "sum_from_a_and_b", "sum_from_coded_c"),
    ("engine", "row_scan_predicate", "col_scan_avx2"),
    ("engine", "lookup_4k_independent_bsearch", "lookup_4k_direct_id"),
    ("joint", "brute_materialized_scan", "joint_cells_over_bases"),
    ("joint", "brute_mixed_bulk_and_exceptions", "joint_mixed_bulk_and_exceptions"),
    ("correlation", "full_columns_tight", "block_bounds_tight"),
    ("correlation", "full_columns_none", "block_bounds_none"),
    ("correlation", "full_columns_tight", "model_prune_tight"),
    ("shared_state", "private_counts", "shared_index_counts"),
]


def _at_rank(times: DataFrame, shares: dict[str, float]) -> DataFrame:
    """experiment, variant, and the value at the nearest rank of each share, from counts of distinct times."""
    counts = times.groupBy("experiment", "variant", "ns").agg(F.count("*").alias("c"))
    group = Window.partitionBy("experiment", "variant")
    placed = counts.withColumn("upto", F.sum("c").over(group.orderBy("ns"))).withColumn("n", F.sum("c").over(group))
    rank = lambda p: F.floor((F.col("n") - 1) * F.lit(p) + 0.5) + 1
    return placed.groupBy("experiment", "variant").agg(*(F.min(F.when(F.col("upto") >= rank(p), F.col("ns"))).alias(name) for name, p in shares.items()))


def percentiles(times: DataFrame, p: float) -> DataFrame:
    """experiment, variant, value at the nearest rank of ``ns``."""
    return _at_rank(times, {"value": p})


def summarize(times: DataFrame) -> DataFrame:
    """experiment, variant, min_ns, median_ns, p99_ns, mean_ns, iters."""
    plain = times.groupBy("experiment", "variant").agg(F.min("ns").alias("min_ns"), F.avg("ns").alias("mean_ns"), F.count("*").alias("iters"))
    return plain.join(_at_rank(times, {"median_ns": 0.5, "p99_ns": 0.99}), ["experiment", "variant"]).select("experiment", "variant", "min_ns", "median_ns", "p99_ns", "mean_ns", "iters")


def best(records: DataFrame) -> DataFrame:
    """The fastest variant of each experiment that was timed at all."""
    timed = records.filter("median_ns > 0")
    return timed.groupBy("experiment").agg(F.min_by("variant", F.struct("median_ns", "variant")).alias("variant"), F.min("median_ns").alias("median_ns"))


def speedups(records: DataFrame, pairs: list[tuple[str, str, str]] = PAIRS) -> DataFrame:
    """experiment, before, after, n, params, speedup of pairs at the same size and parameters; unmeasurable times drop out."""
    wanted = F.broadcast(records.sparkSession.createDataFrame(pairs, "experiment string, before string, after string"))
    side = lambda name: records.select("experiment", F.col("variant").alias(name), "n", "params", F.col("median_ns").alias(f"{name}_ns"))
    both = wanted.join(side("before"), ["experiment", "before"]).join(side("after"), ["experiment", "after", "n", "params"])
    both = both.filter("before_ns > 0 AND after_ns > 0")
    return both.select("experiment", "before", "after", "n", "params", (F.col("before_ns").cast("double") / F.col("after_ns").cast("double")).alias("speedup"))


def time_ns(run: Callable[[], object], warmup: int = 1, iters: int = 3, least_ns: int = 1_000) -> list[int]:
    """Times of an action, repeated within a sample until that is measurable."""
    for _ in range(warmup):
        run()
    reps = 1
    while True:
        began = time.perf_counter_ns()
        for _ in range(reps):
            run()
        if time.perf_counter_ns() - began >= least_ns or reps >= 1_000_000:
            break
        reps *= 4
    out = []
    for _ in range(iters):
        began = time.perf_counter_ns()
        for _ in range(reps):
            run()
        out.append((time.perf_counter_ns() - began) // reps)
    return out


def record(spark: SparkSession, experiment: str, variant: str, n: int, params: str, times: list[int], ops: int, bytes_touched: int, notes: str = "") -> DataFrame:
    """One record of :data:`sparelane.sources.records.SCHEMA` from measured times."""
    rows = spark.createDataFrame([(experiment, variant, t) for t in times], "experiment string, variant string, ns bigint")
    wide = lambda c: F.col(c).cast("decimal(38,0)").alias(c)
    return summarize(rows).select("experiment", "variant", F.lit(n).cast("bigint").alias("n"), F.lit(params).alias("params"), wide("median_ns"), wide("p99_ns"), wide("min_ns"), "mean_ns", F.col("iters").cast("int").alias("iters"), F.lit(ops).cast("bigint").alias("ops"), F.lit(bytes_touched).cast("bigint").alias("bytes_touched"), F.lit(None).cast("string").alias("extra"), F.lit(notes).alias("notes"))
