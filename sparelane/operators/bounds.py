"""Filters decided by parts of a value or by block minima and maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket_high, bucket_low, high16, low16

BLOCK = 1024


def split(df: DataFrame, v: str = "v") -> DataFrame:
    """``df`` with the value's halves (hi, lo) and the bounds that hi alone gives."""
    return df.withColumns({"hi": high16(v), "lo": low16(v)}).withColumns({"at_least": bucket_low("hi"), "at_most": bucket_high("hi")})


def count_above(df: DataFrame, t: int) -> DataFrame:
    return df.filter(F.col("v") > t).agg(F.count("*").alias("n"))


def count_above_by_bucket(df: DataFrame, t: int) -> DataFrame:
    """The same from hi first; lo only where hi equals the threshold's."""
    hi, lo = t >> 16, t & 65535
    hit = F.when(F.col("hi") > hi, 1).when((F.col("hi") == hi) & (F.col("lo") > lo), 1).otherwise(0)
    return split(df).agg(F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("n"))


def argmin(df: DataFrame) -> DataFrame:
    """id, v of the smallest value, the first of equals; no row for no rows."""
    return df.agg(F.min(F.struct("v", "id")).alias("m")).filter("m IS NOT NULL").select("m.id", "m.v")


def argmin_bounded(df: DataFrame) -> DataFrame:
    """The same among the rows of the least high half only."""
    parts = split(df)
    least = parts.agg(F.min("hi").alias("least"))
    return argmin(parts.join(F.broadcast(least), F.col("hi") == F.col("least")))


def summary(df: DataFrame, width: int = BLOCK, v: str = "v") -> DataFrame:
    """block, mn, mx, n for blocks of consecutive ids; the id is dense, so no rank is needed."""
    return df.groupBy(F.expr(f"id div {width}").alias("block")).agg(F.min(v).alias("mn"), F.max(v).alias("mx"), F.count("*").alias("n"))


def _verdict(t: int, below: bool) -> Column:
    all_in, none_in = ("mx < {}", "mn >= {}") if below else ("mn > {}", "mx <= {}")
    return F.when(F.expr(all_in.format(t)), "accept").when(F.expr(none_in.format(t)), "skip").otherwise("scan")


def verdicts(blocks: DataFrame, t: int, below: bool = False) -> DataFrame:
    return blocks.withColumn("verdict", _verdict(t, below))


def filter_blocks(df: DataFrame, blocks: DataFrame, t: int, width: int = BLOCK, v: str = "v", below: bool = False) -> DataFrame:
    """n of v > t (or < t): whole blocks by their summary, rows only of undecided blocks."""
    said = verdicts(blocks, t, below)
    accepted = said.filter("verdict = 'accept'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    hit = (F.col(v) < t) if below else (F.col(v) > t)
    todo = said.filter("verdict = 'scan'").select("block")
    scanned = df.withColumn("block", F.expr(f"id div {width}")).filter(hit).join(todo, "block", "left_semi").agg(F.count("*").alias("n"))
    return accepted.unionAll(scanned).agg(F.sum("n").cast("bigint").alias("n"))


def block_counts(blocks: DataFrame, t: int, below: bool = False) -> DataFrame:
    said = verdicts(blocks, t, below)
    return said.agg(*(F.count_if(F.col("verdict") == x).alias(x) for x in ("accept", "skip", "scan")), F.count("*").alias("blocks"))
