"""Top-1 by a weighted score, answered from ranges of weights.

Items are (g, id, x, y) in whole numbers; the score at weight k of 0..scale is
k x + (scale - k) y, lower is better, ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ceil_div, floor_div, weighted_score

SCALE = 200
#: Parts that a group's front is first looked for in, so that a large group isn't one task.
SALTS = 32


def brute_winner(items: DataFrame, weights: DataFrame, scale: int = SCALE) -> DataFrame:
    """g, k, winner, score, gap (to the second best; null if there is none): every item at every weight.

    ``weights`` is one column k of 0..scale, so it is bounded by the scale and broadcast.
    """
    scored = items.join(F.broadcast(weights), F.lit(True)).select("g", "k", "id", weighted_score("x", "y", "k", scale).alias("s"))
    # the two best as sorted pairs, merged before the shuffle
    best = scored.groupBy("g", "k").agg(F.min(F.struct("s", "id")).alias("a"))
    second = scored.join(best.select("g", "k", F.col("a.id").alias("w")), ["g", "k"]).filter("id <> w").groupBy("g", "k").agg(F.min("s").alias("s2"))
    return best.join(second, ["g", "k"], "left").select("g", "k", F.col("a.id").alias("winner"), F.col("a.s").alias("score"), (F.col("s2") - F.col("a.s")).alias("gap"))


def winner_only(items: DataFrame, weights: DataFrame, scale: int = SCALE) -> DataFrame:
    scored = items.join(F.broadcast(weights), F.lit(True)).select("g", "k", F.struct(weighted_score("x", "y", "k", scale).alias("s"), "id").alias("a"))
    return scored.groupBy("g", "k").agg(F.min("a").alias("a")).select("g", "k", F.col("a.id").alias("winner"), F.col("a.s").alias("score"))


def _undominated(items: DataFrame, by: list[str]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    return items.withColumn("__least", F.min("y").over(before)).filter("__least IS NULL OR y <= __least").drop("__least")


def weak_front(items: DataFrame) -> DataFrame:
    """Items that no other beats strictly on both coordinates; equal scores keep all their ids.

    Fronts of hashed parts of a group come first: what is beaten in a part is beaten in the group.
    """
    parts = items.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return _undominated(_undominated(parts, ["g", "__part"]).drop("__part"), ["g"])


def two_skyband(items: DataFrame) -> DataFrame:
    """A superset of the items that at most one other beats: the front, and the front of the rest."""
    front = weak_front(items)
    rest = items.join(front.select("g", "id"), ["g", "id"], "left_anti")
    return front.unionByName(weak_front(rest))


def cells(items: DataFrame, scale: int = SCALE) -> DataFrame:
    """g, klo, khi, id: the whole weights at which an item has the best score, ends included."""
    front = weak_front(items).select("g", "id", "x", "y", (F.col("x") - F.col("y")).alias("slope"))
    other = front.select("g", F.col("y").alias("oy"), F.col("slope").alias("os")).distinct()
    # score <= other's: k (slope - os) <= scale (oy - y)
    step, room = F.col("slope") - F.col("os"), F.lit(scale) * (F.col("oy") - F.col("y"))
    bound = front.join(other, "g").groupBy("g", "id").agg(
        F.greatest(F.lit(0), F.coalesce(F.max(F.when(step < 0, ceil_div(-room, -step))), F.lit(0))).alias("klo"),
        F.least(F.lit(scale), F.coalesce(F.min(F.when(step > 0, floor_div(room, step))), F.lit(scale))).alias("khi"),
        F.coalesce(F.bool_and(F.when(step == 0, room >= 0)), F.lit(True)).alias("fits"),
    )
    return bound.filter("fits AND klo <= khi").select("g", F.col("klo").cast("bigint").alias("klo"), F.col("khi").cast("bigint").alias("khi"), "id")


def lookup(cell_table: DataFrame, weights: DataFrame) -> DataFrame:
    """g, k, winner: the smallest id of the cells that hold the weight."""
    return cell_table.join(F.broadcast(weights), F.col("k").between(F.col("klo"), F.col("khi"))).groupBy("g", "k").agg(F.min("id").alias("winner"))


def apply_updates(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items after an update log (id, seq, x, y): the last version of each id."""
    last = updates.groupBy("id").agg(F.max_by(F.struct("x", "y"), "seq").alias("v"))
    return items.join(last, "id", "left").select("g", "id", F.coalesce("v.x", "x").alias("x"), F.coalesce("v.y", "y").alias("y"))


def drift(items: DataFrame, updates: DataFrame) -> DataFrame:
    """g, drift: the largest change of a coordinate over all versions, intermediate ones too."""
    moved = updates.select("id", F.col("x").alias("nx"), F.col("y").alias("ny")).join(items, "id")
    by = moved.groupBy("g").agg(F.max(F.greatest(F.abs(F.col("nx") - F.col("x")), F.abs(F.col("ny") - F.col("y")))).alias("d"))
    return items.select("g").distinct().join(by, "g", "left").select("g", F.coalesce("d", F.lit(0)).alias("drift"))


def answers(items: DataFrame, weights: DataFrame, scale: int = SCALE) -> DataFrame:
    """g, k, winner, gap of the certified items: kept as state."""
    gaps = brute_winner(two_skyband(items), weights, scale).select("g", "k", "gap")
    return lookup(cells(items, scale), weights).join(gaps, ["g", "k"])


def certified(items: DataFrame, updates: DataFrame, weights: DataFrame, scale: int = SCALE, state: DataFrame | None = None) -> DataFrame:
    """g, k, winner, hit on the current items.

    A kept answer (``state``, from :func:`answers`) holds if twice the drift can't close the gap at that
    very weight; only the other weights are worked out anew.
    """
    now = apply_updates(items, updates)
    held = (answers(items, weights, scale) if state is None else state).join(drift(items, updates), "g")
    tested = held.withColumn("hit", F.coalesce(F.col("gap") > 2 * scale * F.col("drift"), F.lit(True)))
    miss = tested.filter(~F.col("hit")).select("g", "k")
    scored = weak_front(now).join(miss, "g").select("g", "k", F.struct(weighted_score("x", "y", "k", scale).alias("s"), "id").alias("a"))
    anew = scored.groupBy("g", "k").agg(F.min("a")["id"].alias("anew"))
    return tested.join(anew, ["g", "k"], "left").select("g", "k", F.when(F.col("hit"), F.col("winner")).otherwise(F.col("anew")).alias("winner"), "hit")


def counters(certified_answers: DataFrame) -> DataFrame:
    """hits, misses, rebuilds: answers that held, answers worked out anew, and groups that had any of these."""
    miss = ~F.col("hit")
    return certified_answers.agg(F.count_if("hit").alias("hits"), F.count_if(miss).alias("misses"), F.count_distinct(F.when(miss, F.col("g"))).alias("rebuilds"))


def hull_in_pandas(items: DataFrame, scale: int = SCALE) -> DataFrame:
    """:func:`cells` for groups whose front is too large for pairwise bounds: a sequential hull per group."""

    def hull(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["x", "y", "id"])
        lines = sorted({(int(a) - int(b), int(b)) for a, b in zip(pdf.x, pdf.y, strict=True)}, key=lambda t: (-t[0], t[1]))
        out: list[tuple[int, int]] = []
        for s, y in lines:
            if out and out[-1][0] == s:
                continue
            # the middle line goes if the new one passes it before it passes the one before it
            while len(out) >= 2 and (y - out[-2][1]) * (out[-2][0] - out[-1][0]) < (out[-1][1] - out[-2][1]) * (out[-2][0] - s):
                out.pop()
            out.append((s, y))
        rows = []
        for i, (s, y) in enumerate(out):
            # k (s - a) <= scale (b - y) against the neighbours on either side
            lo = max([0, *(-((scale * (b - y)) // (a - s)) for a, b in out[max(0, i - 1) : i])])
            hi = min([scale, *((scale * (b - y)) // (s - a) for a, b in out[i + 1 : i + 2])])
            if lo <= hi:
                ids = pdf.id[(pdf.x - pdf.y == s) & (pdf.y == y)]
                rows += [(pdf.g.iloc[0], lo, hi, int(j)) for j in ids]
        return pd.DataFrame(rows, columns=["g", "klo", "khi", "id"])

    kind = items.schema["g"].dataType.simpleString()
    return weak_front(items).groupBy("g").applyInPandas(hull, f"g {kind}, klo bigint, khi bigint, id bigint")
