"""Regions whose bulk changes are operations, not rewrites.

A region is base rows (region, id, base) and a log (region, seq, kind, k, id): ``bulk`` adds k
to all current rows, ``insert`` adds a row of price k, which later bulks change too, and
``exception`` sets the row's own addition to k. price = base + bulks since birth + exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import prefix_sums


def births(log: DataFrame) -> DataFrame:
    """The log with ``adj``: the sum of the region's bulks up to each operation."""
    step = F.coalesce(F.when(F.col("kind") == "bulk", F.col("k")), F.lit(0)).cast("bigint")
    return prefix_sums(log.withColumn("step", step), "seq", F.col("step"), "adj", [], ["region"]).withColumn("adj", F.col("adj") + F.col("step")).drop("step")


def adjustments(log: DataFrame) -> DataFrame:
    """region, total: all bulks."""
    return log.filter("kind = 'bulk'").groupBy("region").agg(F.sum("k").alias("total"))


def exceptions(log: DataFrame) -> DataFrame:
    """region, id, exception: the last one set for each row."""
    return log.filter("kind = 'exception'").groupBy("region", "id").agg(F.max_by("k", "seq").alias("exception"))


def members(base: DataFrame, log: DataFrame) -> DataFrame:
    """region, id, base, birth: base rows and inserted ones."""
    inserted = births(log).filter("kind = 'insert'").select("region", "id", F.col("k").alias("base"), F.col("adj").alias("birth"))
    return base.select("region", "id", "base", F.lit(0).cast("bigint").alias("birth")).unionByName(inserted)


def prices(base: DataFrame, log: DataFrame) -> DataFrame:
    """region, id, price of every row."""
    rows = members(base, log).join(exceptions(log), ["region", "id"], "left").join(adjustments(log), "region", "left")
    price = F.col("base") + F.coalesce("total", F.lit(0)) - F.col("birth") + F.coalesce("exception", F.lit(0))
    return rows.select("region", "id", price.alias("price"))


def base_sums(base: DataFrame) -> DataFrame:
    """region, n, b: what a sum needs of the base rows; kept as state."""
    return base.groupBy("region").agg(F.count("*").alias("n"), F.sum("base").alias("b"))


def sums_of(state: DataFrame, log: DataFrame) -> DataFrame:
    """region, n, total from :func:`base_sums` and the log alone; its exceptions are of rows that are there."""
    inserted = births(log).filter("kind = 'insert'").groupBy("region").agg(F.count("*").alias("m"), F.sum("k").alias("k"), F.sum("adj").alias("births"))
    own = exceptions(log).groupBy("region").agg(F.sum("exception").alias("e"))
    out = state.join(inserted, "region", "full").join(adjustments(log), "region", "left").join(own, "region", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("n") + zero("m")
    return out.select("region", n.alias("n"), (zero("b") + zero("k") + zero("total") * n - zero("births") + zero("e")).alias("total"))


def region_sums(base: DataFrame, log: DataFrame) -> DataFrame:
    """region, n, total from sums alone: base + adj n - births + exceptions. No base row is joined."""
    rows = members(base, log).groupBy("region").agg(F.count("*").alias("n"), F.sum("base").alias("b"), F.sum("birth").alias("births"))
    own = exceptions(log).groupBy("region").agg(F.sum("exception").alias("e"))
    out = rows.join(adjustments(log), "region", "left").join(own, "region", "left")
    total = F.col("b") + F.coalesce("total", F.lit(0)) * F.col("n") - F.col("births") + F.coalesce("e", F.lit(0))
    return out.select("region", "n", total.alias("total"))


def materialized_sums(base: DataFrame, bulks: list[int]) -> DataFrame:
    """The baseline: every bulk rewrites all prices."""
    rows = base.select("region", F.col("base").alias("price"))
    for k in bulks:
        rows = rows.withColumn("price", F.col("price") + F.lit(k))
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def lookup_sum(base: DataFrame, log: DataFrame, probes: DataFrame) -> DataFrame:
    """region, n, total of the prices of probed ids (region, id; repeats count)."""
    found = prices(base, log).join(probes.select("region", "id"), ["region", "id"])
    return found.groupBy("region").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def filter_counts(base: DataFrame, log: DataFrame, above: int) -> DataFrame:
    """region, n of base rows with base + adj > above: the shift is worked out per region, and base > above - adj reaches the scan as a literal.

    Regions are few: a bound for each goes to the driver.
    """
    shifts = {r.region: r.total for r in adjustments(log).collect()}
    limit = F.lit(above)
    for region, total in sorted(shifts.items(), key=lambda x: str(x[0])):
        limit = F.when(F.col("region").eqNullSafe(F.lit(region)), F.lit(above - total)).otherwise(limit)
    least = above - max([0, *shifts.values()])
    found = base.filter(F.col("base") > F.lit(least)).filter(F.col("base") > limit).groupBy("region").agg(F.count("*").alias("n"))
    regions = base.select("region").distinct()
    return regions.join(found.withColumnRenamed("region", "r"), F.col("region").eqNullSafe(F.col("r")), "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))


def density_sums(base: DataFrame, every: DataFrame, value: int) -> DataFrame:
    """every, total: all bases and an exception of ``value`` on each row whose id is a multiple of ``every`` (0: none)."""
    counts = base.join(F.broadcast(every), F.lit(True)).groupBy("every").agg(F.sum("base").alias("b"), F.count_if((F.col("every") > 0) & (F.try_mod("id", "every") == 0)).alias("n"))
    return counts.select("every", (F.col("b") + F.lit(value) * F.col("n")).alias("total"))
