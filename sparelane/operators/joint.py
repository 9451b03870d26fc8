"""A catalog of ranked items whose prices change in bulk: price = base + adj + exception.

A bulk change adds w adj to every score of its group, which no ranking sees, so the cells over
base + exception stay valid; only an exception makes new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import weighted_score
from . import ranking


def with_exceptions(items: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Items (g, id, x, y) with the last exception (id, seq, k) of each added to x."""
    last = exceptions.groupBy("id").agg(F.max_by("k", "seq").alias("e"))
    return items.join(last, "id", "left").select("g", "id", (F.col("x") + F.coalesce("e", F.lit(0))).alias("x"), "y")


def current(items: DataFrame, exceptions: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Items at current prices; ``adjustments``: g, adj."""
    return with_exceptions(items, exceptions).join(adjustments, "g", "left").select("g", "id", (F.col("x") + F.coalesce("adj", F.lit(0))).alias("x"), "y")


def brute(items: DataFrame, exceptions: DataFrame, adjustments: DataFrame, weights: DataFrame) -> DataFrame:
    return ranking.winner_only(current(items, exceptions, adjustments), weights).select("g", "k", "winner")


def winners(items: DataFrame, exceptions: DataFrame, weights: DataFrame) -> DataFrame:
    """g, k, winner from cells that know nothing of bulk changes."""
    return ranking.lookup(ranking.cells(with_exceptions(items, exceptions)), weights)


def mixed(items: DataFrame, exceptions: DataFrame, queries: DataFrame) -> DataFrame:
    """g, q, k, winner for a log: exceptions (id, seq, k) and queries (q, k) in the order of seq and q.

    Exceptions with seq <= q hold for a query. Those before the same exception share an epoch, and an
    epoch its cells; bulk changes start none. The log's epochs are its parameters, and small.
    """
    return _by_epoch(items, exceptions, queries, F.max_by("k", "seq"))


def jittered(items: DataFrame, changes: DataFrame, queries: DataFrame) -> DataFrame:
    """g, q, k, winner for a log of changes (id, seq, k) of single rows, which add up, unlike exceptions.

    The control of :func:`mixed`: no bulk identity covers such a change, so each starts an epoch and new cells.
    """
    return _by_epoch(items, changes, queries, F.sum("k"))


def _by_epoch(items: DataFrame, exceptions: DataFrame, queries: DataFrame, held_of) -> DataFrame:
    epochs = exceptions.select("seq").distinct().unionAll(exceptions.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("seq"))).select(F.col("seq").alias("epoch"))
    spans = epochs.withColumn("until", F.lead("epoch").over(Window.orderBy("epoch")))
    held = exceptions.join(F.broadcast(epochs), F.col("seq") <= F.col("epoch")).groupBy("epoch", "id").agg(held_of.alias("e"))
    at = items.join(F.broadcast(epochs), F.lit(True)).join(held, ["epoch", "id"], "left")
    staged = at.select(F.struct("epoch", "g").alias("g"), "id", (F.col("x") + F.coalesce("e", F.lit(0))).alias("x"), "y")
    cell = ranking.cells(staged).select(F.col("g.epoch").alias("epoch"), F.col("g.g").alias("g"), "klo", "khi", "id")
    asked = queries.join(F.broadcast(spans), (F.col("q") >= F.col("epoch")) & (F.col("until").isNull() | (F.col("q") < F.col("until")))).select("q", "k", "epoch")
    return cell.join(asked, "epoch").filter(F.col("k").between(F.col("klo"), F.col("khi"))).groupBy("g", "q", "k").agg(F.min("id").alias("winner"))


def mixed_brute(items: DataFrame, exceptions: DataFrame, queries: DataFrame, bulk_every: int, bulk: int) -> DataFrame:
    """The same from current prices at every query, bulk changes included."""
    held = exceptions.join(F.broadcast(queries), F.col("seq") <= F.col("q")).groupBy("q", "id").agg(F.max_by(exceptions["k"], "seq").alias("e"))
    rows = items.join(F.broadcast(queries), F.lit(True)).join(held, ["q", "id"], "left")
    x = F.col("x") + F.coalesce("e", F.lit(0)) + F.expr(f"q div {bulk_every}") * bulk
    scored = rows.select("g", "q", "k", F.struct(weighted_score(x, "y", "k").alias("s"), "id").alias("a"))
    return scored.groupBy("g", "q", "k").agg(F.min("a")["id"].alias("winner"))
