"""A redundant column c = a + b that recovers a and answers sums of a + b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(20,0)"


def build(df: DataFrame) -> DataFrame:
    """``df`` (a, b) with c; 20 digits hold any sum of two 64-bit integers."""
    return df.withColumn("c", (F.col("a").cast(WIDE) + F.col("b").cast(WIDE)).cast(WIDE))


def recover_a(coded: DataFrame) -> DataFrame:
    return coded.withColumn("a", (F.col("c") - F.col("b").cast(WIDE)).cast("bigint"))


def checksum(rows: DataFrame) -> DataFrame:
    """checksum: the sum of ``a`` as 64-bit additions that wrap give it; 0 of no rows."""
    half, whole = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (63, 64))
    return rows.agg(_sum(F.col("a").cast(WIDE))).select((F.pmod(F.col("total") + half, whole) - half).cast("bigint").alias("checksum"))


def _sum(column) -> DataFrame:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(38,0)").alias("total")


def sum_from_code(coded: DataFrame) -> DataFrame:
    """One column is read."""
    return coded.agg(_sum(F.col("c")))


def sum_from_sources(df: DataFrame) -> DataFrame:
    return df.agg(_sum(F.col("a").cast(WIDE) + F.col("b").cast(WIDE)))


def filter_sum(coded: DataFrame, above: int) -> DataFrame:
    """Sum of a + b where it is above the threshold, from c alone."""
    return coded.filter(F.col("c") > F.lit(above).cast(WIDE)).agg(_sum(F.col("c")))


def filter_sum_a(df: DataFrame, above: int) -> DataFrame:
    """Sum of a where a is above the threshold: c is of no use."""
    return df.filter(F.col("a") > above).agg(_sum(F.col("a")))
