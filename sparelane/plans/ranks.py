"""Prefix sums and ranks over a whole table without a single-partition window.

Keys fall into cells of ``WIDTH`` and cells into blocks of ``WIDTH`` cells. Sums of cells and
blocks are aggregated first; only block sums, a ``WIDTH`` ** 2 of the keys' span, are summed up
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def prefix_sums(df: DataFrame, key: str, value: Column, out: str = "before", order: list | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``key`` (a whole number), among those equal in ``by``.

    ``order``: further columns that order rows of one key; without them such rows count as equal,
    and none of them before another.
    """
    by = by or []
    rows = df.withColumn("__v", value).withColumn("__cell", F.floor(F.col(key) / WIDTH)).withColumn("__block", F.floor(F.col(key) / (WIDTH * WIDTH)))
    cells = rows.groupBy(*by, "__block", "__cell").agg(F.sum("__v").alias("__s"))
    in_block = F.coalesce(F.sum("__s").over(Window.partitionBy(*by, "__block").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over_blocks = (Window.partitionBy(*by).orderBy("__block") if by else Window.orderBy("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy(*by, "__block").agg(F.sum("__s").alias("__s")).select(*by, "__block", F.coalesce(F.sum("__s").over(over_blocks), F.lit(0)).alias("__b"))
    before = cells.select(*by, "__block", "__cell", in_block.alias("__c")).join(blocks, [*by, "__block"]).select(*by, "__cell", (F.col("__b") + F.col("__c")).alias("__before"))
    cell = Window.partitionBy(*by, "__cell")
    if order is None:
        inside = F.sum("__v").over(cell.orderBy(key).rangeBetween(Window.unboundedPreceding, -1))
    else:
        inside = F.sum("__v").over(cell.orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1))
    out_rows = rows.join(before, [*by, "__cell"]).withColumn(out, F.col("__before") + F.coalesce(inside, F.lit(0)))
    return out_rows.drop("__v", "__cell", "__block", "__before")


def ranks(df: DataFrame, key: str, out: str = "rank", order: list | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with the number of rows before each, among those equal in ``by``."""
    return prefix_sums(df, key, F.lit(1).cast("bigint"), out, order or [], by)
