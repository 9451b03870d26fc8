"""Connected components of an edge table, by hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _jumped(parents: DataFrame) -> DataFrame:
    """``x``, the parent of its parent, and whether that is another one."""
    up = parents.select(F.col("x").alias("y"), F.col("p").alias("q"))
    return parents.join(up, F.col("p") == F.col("y"), "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))


def _roots(parents: DataFrame) -> DataFrame:
    """``x`` and the root that following ``p`` (smaller than ``x``) ends at."""
    while True:
        parents = materialize(_jumped(_jumped(parents).select("x", "p")), "parents")
        if not parents.filter("moved").limit(1).count():
            return parents.select("x", "p")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for the nodes of ``edges`` (a, b).

    Every round each label hooks to its smallest neighbour, so labels at least halve; rounds and
    jumps are logarithmic, and no component is ever in one task.
    """
    ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("p")).filter("x <> p").distinct()
    labels = ends.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        left = materialize(left, "left")
        if not left.limit(1).count():
            return labels
        roots = _roots(left.groupBy("x").agg(F.min("p").alias("p")))
        labels = materialize(labels.join(roots, F.col("label") == F.col("x"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        a, b = (roots.select(F.col("x").alias(f"x{i}"), F.col("p").alias(f"p{i}")) for i in "ab")
        moved = left.join(a, F.col("x") == F.col("xa"), "left").join(b, F.col("p") == F.col("xb"), "left").select(F.coalesce("pa", "x").alias("s"), F.coalesce("pb", "p").alias("t"))
        left = moved.filter("s <> t").select(F.greatest("s", "t").alias("x"), F.least("s", "t").alias("p")).distinct()
