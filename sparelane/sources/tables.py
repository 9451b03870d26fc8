"""Tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column | str) -> Column:
    """An amount of two decimals as whole hundredths."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.round(amount * 100).cast("bigint")
