"""Counts of keys in half-open ranges (q, lo, hi), per query or from one shared state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import prefix_sums


def rescan(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """q, n: every query against every key. The queries are the given parameters of the call."""
    hit = keys.join(F.broadcast(queries), (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    return queries.select("q").join(hit.groupBy("q").agg(F.count("*").alias("n")), "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def matches(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """Private state: q, k of every match, one row each."""
    return keys.join(F.broadcast(queries), (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).select("q", "k")


def insert_private(state: DataFrame, queries: DataFrame, inserted: DataFrame) -> DataFrame:
    return state.unionByName(matches(inserted, queries))


def private_counts(state: DataFrame, queries: DataFrame) -> DataFrame:
    n = state.groupBy("q").agg(F.count("*").alias("n"))
    return queries.select("q").join(n, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def shared_state(keys: DataFrame) -> DataFrame:
    """k, n: each distinct key once, with its number."""
    return keys.groupBy("k").agg(F.count("*").alias("n"))


def insert_shared(state: DataFrame, inserted: DataFrame) -> DataFrame:
    return state.unionByName(shared_state(inserted)).groupBy("k").agg(F.sum("n").alias("n"))


def shared_counts(state: DataFrame, queries: DataFrame) -> DataFrame:
    """q, n: keys below hi less keys below lo. Ends join the key stream with weight 0, so repeats count right."""
    ends = queries.select("q", F.explode(F.array(F.struct(F.col("lo").alias("k"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("k"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("q", F.col("e.k").alias("k"), F.col("e.sign").alias("sign"), F.lit(0).cast("bigint").alias("n"))
    stream = state.select(F.lit(None).cast("bigint").alias("q"), "k", F.lit(None).cast("int").alias("sign"), "n").unionByName(ends.withColumn("q", F.col("q").cast("bigint")))
    below = prefix_sums(stream, "k", F.col("n")).filter("q IS NOT NULL")
    return below.groupBy("q").agg(F.greatest(F.lit(0), F.sum(F.col("sign") * F.col("before"))).cast("bigint").alias("n"))


def cells(state: DataFrame, width: int = 4096) -> DataFrame:
    """:func:`shared_state` with the cell of each key, in order: kept as state beside :func:`cell_sums`."""
    return state.select(F.floor(F.col("k") / width).alias("cell"), "k", "n").repartitionByRange("cell").sortWithinPartitions("k")


def cell_sums(cell_table: DataFrame) -> DataFrame:
    return cell_table.groupBy("cell").agg(F.sum("n").alias("n"))


def stored_counts(cell_table: DataFrame, sums: DataFrame, queries: DataFrame, width: int = 4096) -> DataFrame:
    """q, n from the kept state: whole cells between the ends from their sums, keys only of the cells that hold an end."""
    asked = queries.select("q", "lo", F.greatest("lo", "hi").alias("hi"), F.floor(F.col("lo") / width).alias("a"), F.floor(F.greatest("lo", "hi") / width).alias("b"))
    ends = sorted({c for r in asked.select("a", "b").collect() for c in (r.a, r.b)})  # the call's own parameters
    inside = sums.join(F.broadcast(asked), (F.col("cell") > F.col("a")) & (F.col("cell") < F.col("b"))).select("q", "n")
    edge = cell_table.filter(F.col("cell").isin(ends)).join(F.broadcast(asked), ((F.col("cell") == F.col("a")) | (F.col("cell") == F.col("b"))) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).select("q", "n")
    n = inside.unionAll(edge).groupBy("q").agg(F.sum("n").alias("n"))
    return queries.select("q").join(n, "q", "left").select("q", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
