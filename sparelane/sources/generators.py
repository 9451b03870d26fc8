"""Deterministic inputs: every value is a function of the row's id, so partitioning doesn't change it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import prefix_sums


def draw(below: int, seed: int, *of: Column | str) -> Column:
    """A whole number of 0 .. below - 1."""
    return F.pmod(F.xxhash64(*(of or ("id",)), F.lit(seed)), F.lit(below))


def unit(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1)."""
    return draw(1 << 52, seed, *of) / float(1 << 52)


def groups(spark: SparkSession, n_groups: int, per_group: int, seed: int = 1) -> DataFrame:
    """Two-sided groups: side, g, ord, v in 1..49."""
    rows = spark.range(2 * n_groups * per_group)
    return rows.select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("side"),
        F.expr(f"id div {2 * per_group}").alias("g"),
        F.expr(f"(id div 2) % {per_group}").alias("ord"),
        (draw(49, seed) + 1).alias("v"),
    )


def products(spark: SparkSession, n: int, mode: str = "pareto", seed: int = 2) -> DataFrame:
    """Items with price and delivery: a front and dominated rest (pareto), near_tie, random, or a strictly convex front."""
    rows = spark.range(n)
    a, b = unit(seed), unit(seed + 1)
    if mode == "near_tie":
        return rows.select("id", (10 + a * 0.05).alias("price"), (10 + b * 0.05).alias("delivery"))
    if mode == "random":
        return rows.select("id", (a * 20).alias("price"), (b * 20).alias("delivery"))
    front = max(8, min(64, n // 40))
    t = F.col("id") / float(max(front - 1, 1))
    if mode == "convex":
        i = F.col("id").cast("double")
        on = (i * i, (front - 1 - i) * (front - 1 - i))
        off = (a * front * front + front * front, b * front * front + front * front)
    else:
        on = (1 + 18 * t, 19 - 18 * t)
        off = (4 + 18 * a + 5 * unit(seed + 2), 4 + 18 * (1 - a) + 5 * unit(seed + 3))
    is_front = F.col("id") < front
    return rows.select("id", F.when(is_front, on[0]).otherwise(off[0]).alias("price"), F.when(is_front, on[1]).otherwise(off[1]).alias("delivery"))


def catalog_items(spark: SparkSession, n: int, seed: int = 3) -> DataFrame:
    return products(spark, n, "pareto", seed).select("id", F.col("price").alias("price_base"), "delivery", F.lit(0.0).alias("exception"))


def weights(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 4) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("q"), (low + (high - low) * unit(seed)).alias("w"))


def values(spark: SparkSession, n: int, clustered: bool, seed: int = 5) -> DataFrame:
    """Ascending values of 1,000,000..1,049,999, or values of 28 bits in no order."""
    v = F.lit(1_000_000) + F.expr(f"(id * 50000) div {max(n, 1)}") if clustered else draw(1 << 28, seed)
    return spark.range(n).select("id", v.alias("v"))


def key_set(spark: SparkSession, n: int, start: int = 0, step: int = 1) -> DataFrame:
    """Distinct keys; disjoint, interleaved, sparse or overlapping sets by start and step."""
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias("k"))


def random_edges(spark: SparkSession, n: int, p: float, seed: int = 6) -> DataFrame:
    """Each of the pairs u < v of n vertices with probability p."""
    u, v = spark.range(n).select(F.col("id").alias("u")), spark.range(n).select(F.col("id").alias("v"))
    return u.join(v, F.col("u") < F.col("v")).filter(unit(seed, "u", "v") < p)


def two_cliques(spark: SparkSession, size: int) -> DataFrame:
    """Two complete graphs without a common vertex: 2 C(size, 3) triangles."""
    u, v = spark.range(2 * size).select(F.col("id").alias("u")), spark.range(2 * size).select(F.col("id").alias("v"))
    return u.join(v, (F.col("u") < F.col("v")) & (F.expr(f"u div {size}") == F.expr(f"v div {size}")))


def bipartite(spark: SparkSession, d: int, extra: int = 0, seed: int = 7) -> DataFrame:
    """A complete bipartite graph, and a few edges inside its left part."""
    u, v = spark.range(d).select(F.col("id").alias("u")), spark.range(d, 2 * d).select(F.col("id").alias("v"))
    inside = spark.range(extra).select(draw(d, seed).alias("u"), draw(d, seed + 1).alias("v")).filter("u <> v")
    return u.join(v, F.lit(True)).unionAll(inside)


def sorted_keys(spark: SparkSession, n: int, shape: str = "linear", seed: int = 8) -> DataFrame:
    """Ascending keys: multiples of 10, gaps of 1..50, or runs of 50..399 with jumps between."""
    if shape == "linear":
        return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("k"))
    if shape == "gaps":
        step = 1 + draw(50, seed)
    else:
        step = F.when(draw(225, seed) == 0, 10_000 + draw(70_000, seed + 1)).otherwise(F.lit(1))
    steps = spark.range(n).select("id", step.cast("bigint").alias("step"))
    return prefix_sums(steps, "id", F.col("step")).select(F.col("id").alias("pos"), (F.col("before") + F.col("step")).alias("k"))


def scan_rows(spark: SparkSession, n: int, seed: int = 9) -> DataFrame:
    """Rows to scan: id, price 1..9,999, qty 0..499, flags 0..15."""
    return spark.range(n).select("id", (1 + draw(9999, seed)).alias("price"), draw(500, seed + 1).alias("qty"), draw(16, seed + 2).cast("int").alias("flags"))


def correlated(spark: SparkSession, n: int, noise: float, by_price: bool = True, seed: int = 10) -> DataFrame:
    """delivery = max(0, 80 - 0.6 price + noise); in price order, or shuffled against price."""
    rows = spark.range(n)
    price = F.col("id") * (100.0 / max(n, 1)) if by_price else unit(seed) * 100
    rows = rows.select("id", price.alias("price"))
    of = F.col("price") if by_price else unit(seed + 2) * 100
    return rows.select("id", "price", F.greatest(F.lit(0.0), 80 - 0.6 * of + unit(seed + 1) * noise).alias("delivery"))


def coded_pairs(spark: SparkSession, n: int, whole_range: bool = False, seed: int = 11) -> DataFrame:
    """a and b within a million of 0, or anywhere in 64 bits."""
    one = (lambda s: F.xxhash64("id", F.lit(s))) if whole_range else (lambda s: draw(2_000_001, s) - 1_000_000)
    return spark.range(n).select("id", one(seed).alias("a"), one(seed + 1).alias("b"))


def range_queries(spark: SparkSession, n: int, below: int, width: int, seed: int = 12) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("q"), draw(below, seed).alias("lo"))
    return rows.withColumn("hi", F.col("lo") + width)


def shared_keys(spark: SparkSession, n: int, seed: int = 13) -> DataFrame:
    """Keys of 0 .. 4n - 1, with repeats."""
    return spark.range(n).select(draw(4 * max(n, 1), seed).alias("k"))


def region_bases(spark: SparkSession, n: int, seed: int = 14) -> DataFrame:
    return spark.range(n).select("id", (50 + draw(4950, seed)).alias("base"))
