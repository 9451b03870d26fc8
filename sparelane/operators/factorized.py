"""Sums over join pairs: per group, sum a_i b_j = (sum a)(sum b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def naive_pair_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """g, total over all pairs: the join is made."""
    right = b.select("g", F.col("v").alias("w")).hint("shuffle_hash")
    return a.select("g", "v").join(right, "g").groupBy("g").agg(F.sum(F.col("v").cast(WIDE) * F.col("w")).alias("total"))


def side_sums(side: DataFrame, name: str) -> DataFrame:
    return side.groupBy("g").agg(F.sum(F.col("v").cast("decimal(19,0)")).cast(WIDE).alias(name))


def factorized_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same, with each side summed before the join: it moves a row a group."""
    return side_sums(a, "sa").join(side_sums(b, "sb"), "g").select("g", (F.col("sa") * F.col("sb")).cast(WIDE).alias("total"))


def total(sums: DataFrame) -> DataFrame:
    return sums.agg(F.coalesce(F.sum("total"), F.lit(0)).cast(WIDE).alias("total"))


def build_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Maintained state g, sum_a, sum_b; a side that a group lacks counts 0."""
    both = side_sums(a, "sum_a").join(side_sums(b, "sum_b"), "g", "full")
    return both.select("g", *(F.coalesce(c, F.lit(0)).cast(WIDE).alias(c) for c in ("sum_a", "sum_b")))


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """State after signed rows (g, side A or B, v, sign): an insert is +1, a delete -1, an update both."""
    part = lambda side: F.when(F.col("side") == side, F.col("sign") * F.col("v")).otherwise(0).cast(WIDE)
    moved = deltas.select("g", part("A").alias("sum_a"), part("B").alias("sum_b"))
    return state.unionByName(moved).groupBy("g").agg(*(F.sum(c).cast(WIDE).alias(c) for c in ("sum_a", "sum_b")))


def result(state: DataFrame) -> DataFrame:
    return state.select("g", (F.col("sum_a") * F.col("sum_b")).cast(WIDE).alias("total"))


def inseparable_pair_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of a_i b_j (i xor j) by the rows' ordinals (``ord``): no product of one-sided terms, so the join stays."""
    right = b.select("g", F.col("v").alias("w"), F.col("ord").alias("j"))
    term = F.col("v").cast(WIDE) * F.col("w") * F.col("ord").bitwiseXOR(F.col("j"))
    return a.join(right, "g").groupBy("g").agg(F.sum(term).cast(WIDE).alias("total"))


def with_ordinals(side: DataFrame, order: list[str]) -> DataFrame:
    """``ord``: the row's place in its group, from 0."""
    return side.withColumn("ord", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).cast("bigint"))
