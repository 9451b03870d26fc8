"""A learned index: line segments that predict a key's position within a known error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import ranks

#: Span of keys that one segmentation task works on; a segment doesn't go beyond it.
SPAN = 1 << 20
SEGMENTS = "cell bigint, key0 bigint, pos0 bigint, slope double, err bigint, n bigint"


def positions(keys: DataFrame) -> DataFrame:
    """pos, k of distinct keys in order, from 0."""
    return ranks(keys.select("k").distinct(), "k", "pos")


def segments(placed: DataFrame, eps: int = 32, span: int = SPAN) -> DataFrame:
    """Greedy segments (key0, pos0, slope, err, n) per span of keys: the slope of the first two keys, kept while the rounded error is at most ``eps``."""

    def cut(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("k")
        k, pos = pdf.k.to_numpy(), pdf.pos.to_numpy()
        rows, i = [], 0
        while i < len(k):
            slope = 1.0 / float(k[i + 1] - k[i]) if i + 1 < len(k) else 0.0
            # look ahead in doubling pieces for the first key that the line misses
            end, step = min(i + 2, len(k)), 64
            while end < len(k):
                stop = min(end + step, len(k))
                miss = np.abs(np.rint((k[end:stop] - k[i]) * slope) + pos[i] - pos[end:stop]) > eps
                if miss.any():
                    end += int(miss.argmax())
                    break
                end, step = stop, step * 2
            err = int(np.abs(np.rint((k[i:end] - k[i]) * slope) + pos[i] - pos[i:end]).max())
            rows.append((int(pdf.cell.iloc[0]), int(k[i]), int(pos[i]), slope, err, end - i))
            i = end
        return pd.DataFrame(rows, columns=["cell", "key0", "pos0", "slope", "err", "n"])

    return placed.withColumn("cell", F.floor(F.col("k") / span)).groupBy("cell").applyInPandas(cut, SEGMENTS)


def lookup(probes: DataFrame, placed: DataFrame, segs: DataFrame, span: int = SPAN) -> DataFrame:
    """q, k, pos of the probes (q, k) that are there: a segment predicts, the keys near the prediction decide."""
    after = F.lead("key0").over(Window.partitionBy("cell").orderBy("key0"))
    ranges = segs.withColumn("key1", after)
    asked = probes.withColumn("cell", F.floor(F.col("k") / span)).join(ranges, "cell").filter("k >= key0 AND (key1 IS NULL OR k < key1)")
    guess = asked.select("q", "k", F.expr("pos0 + cast(rint((k - key0) * slope) as bigint)").alias("guess"), (F.col("err") + 2).alias("room"))
    return guess.join(placed, "k").filter("pos BETWEEN guess - room AND guess + room").select("q", "k", "pos")
