"""Stock reservations as functions of a request log (seq, shard). What is broadcast has a row a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import ranks


def reserve_global(log: DataFrame, stock: int) -> DataFrame:
    """seq, outcome: the first ``stock`` requests get one; ranks come from cell counts, not from one task."""
    return ranks(log, "seq").select("seq", F.when(F.col("rank") < stock, "ok").otherwise("soldout").alias("outcome"))


def split_stock(spark: SparkSession, stock: int, shards: int, held_back: int = 0) -> DataFrame:
    """shard, quota: equal shares of what the coordinator doesn't hold back; the last takes the rest."""
    left = max(0, stock - held_back)
    per = max(left // shards, 1)
    before = F.least(F.col("id") * per, F.lit(left))
    quota = F.when(F.col("id") == shards - 1, left - before).otherwise(F.least(F.lit(per), left - before))
    return spark.range(shards).select(F.col("id").alias("shard"), quota.cast("bigint").alias("quota"))


def reserve_sharded(log: DataFrame, quotas: DataFrame) -> DataFrame:
    """seq, shard, outcome: each shard's first ``quota`` requests."""
    placed = ranks(log, "seq", "r", by=["shard"]).join(F.broadcast(quotas), "shard")
    return placed.select("seq", "shard", F.when(F.col("r") < F.col("quota"), "ok").otherwise("soldout").alias("outcome"))


def accounting(outcomes: DataFrame, stock: int) -> DataFrame:
    """ok, soldout, stranded: what is left in the end; ok + stranded = stock."""
    counted = outcomes.agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "soldout").alias("soldout"))
    return counted.withColumn("stranded", F.lit(stock) - F.col("ok"))


def reserve_restocked(log: DataFrame, stock: int, shards: int, restock: int, held_back: int) -> DataFrame:
    """seq, shard, outcome with a coordinator that hands out up to ``restock`` to a shard that runs dry.

    Which shard gets what depends on the order across shards, but only of the requests that find
    their shard dry: those at whole multiples of ``restock`` beyond a shard's quota. They are ranked
    across shards, and the coordinator serves them until its stock ends. A shard whose request isn't
    served is sold out from there on.
    """
    spark = log.sparkSession
    quotas = split_stock(spark, stock, shards, held_back)
    placed = ranks(log, "seq", "r", by=["shard"]).join(F.broadcast(quotas), "shard").withColumn("over", F.col("r") - F.col("quota"))
    dry = placed.filter((F.col("over") >= 0) & (F.col("over") % restock == 0)).select("seq", "shard", "over")
    # served in turn: all but the last grant are whole, so a grant is known from its rank
    grant = F.greatest(F.lit(0), F.least(F.lit(restock), F.lit(min(held_back, stock)) - F.col("rank") * restock))
    served = ranks(dry, "seq").withColumn("grant", grant).groupBy("shard").agg(F.sum("grant").alias("granted"))
    out = placed.join(F.broadcast(served), "shard", "left")
    fine = F.col("r") < F.col("quota") + F.coalesce("granted", F.lit(0))
    return out.select("seq", "shard", F.when(fine, "ok").otherwise("soldout").alias("outcome"))


def drain(outcomes: DataFrame, quotas: DataFrame) -> DataFrame:
    """Outcomes when what shards have left goes to requests that were turned down, in their order."""
    used = outcomes.filter("outcome = 'ok'").groupBy("shard").agg(F.count("*").alias("used"))
    left = quotas.join(used, "shard", "left").agg(F.sum(F.col("quota") - F.coalesce("used", F.lit(0))).alias("left"))
    turned = ranks(outcomes.filter("outcome = 'soldout'"), "seq").join(F.broadcast(left), F.lit(True))
    again = turned.select("seq", "shard", F.when(F.col("rank") < F.col("left"), "ok").otherwise("soldout").alias("outcome"))
    return outcomes.filter("outcome = 'ok'").unionByName(again)
