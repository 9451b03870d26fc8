"""Intersections of key sets (one column k), and proofs that one is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct keys in both, by sort-merge."""
    return a.select("k").distinct().join(b.select("k").distinct().hint("merge"), "k", "left_semi")


def merge_intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys as often as in the side that has fewer of them."""
    return a.select("k").intersectAll(b.select("k"))


def sparse_intersect(small: DataFrame, large: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """Distinct keys in both; the small side drives if its counted size is below ``bound`` rows."""
    keys = small.select("k").distinct()
    if keys.limit(bound + 1).count() <= bound:
        keys = F.broadcast(keys)
    return large.select("k").join(keys, "k", "left_semi").distinct()


def extrema(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.min("k").alias(f"{name}_mn"), F.max("k").alias(f"{name}_mx"))


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """disjoint: whether extrema alone prove that no key is in both; an empty side does."""
    both = extrema(a, "a").join(extrema(b, "b"), F.lit(True))
    apart = F.col("a_mn").isNull() | F.col("b_mn").isNull() | (F.col("a_mx") < F.col("b_mn")) | (F.col("b_mx") < F.col("a_mn"))
    return both.select(apart.alias("disjoint"))


def certified_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`merge_intersect`, without the join if the extrema rule it out."""
    if disjoint(a, b).first()[0]:
        return a.select("k").limit(0)
    return merge_intersect(a, b)
