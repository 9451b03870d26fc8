"""Scans and batched lookups. Probes keep their repeats: a lookup is an inner join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import payload_ms


def scan(rows: DataFrame, price_above: int) -> DataFrame:
    """n, total of price where price is above the threshold and qty above 0."""
    return rows.filter((F.col("price") > price_above) & (F.col("qty") > 0)).agg(F.count("*").alias("n"), F.coalesce(F.sum("price"), F.lit(0)).cast("bigint").alias("total"))


def found(table: DataFrame, probes: DataFrame, how: str = "auto") -> DataFrame:
    """Rows of the keyed table (k, ...) for each probe (k); ``how``: auto, merge, shuffle_hash."""
    return table.join(probes if how == "auto" else probes.hint(how), "k")


def id_xor(table: DataFrame, probes: DataFrame, how: str = "auto") -> DataFrame:
    return found(table, probes, how).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("k"), F.lit(0)).alias("ids"))


def payload_sum(table: DataFrame, probes: DataFrame) -> DataFrame:
    return found(table, probes).agg(F.count("*").alias("n"), F.coalesce(F.sum("payload"), F.lit(0)).cast("bigint").alias("total"))


def payload_bounds(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """row_bytes, gbit, ms: what moving all rows takes at least."""
    return rows.agg(F.count("*").alias("n")).join(F.broadcast(sizes), F.lit(True)).select("row_bytes", "gbit", payload_ms("n", "row_bytes", "gbit").alias("ms"))
