"""Structured Streaming forms of maintained state: signed deltas, shared counts, late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import factorized, ranges


def maintain(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], fold: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Fold every micro-batch into a stored state. ``write`` gets the batch id and must ignore one it has seen."""

    def batch(rows: DataFrame, epoch: int) -> None:
        write(fold(read(), rows), epoch)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def maintain_pair_sums(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Factorized state from signed rows (g, side, v, sign): deletes and updates too, which append streams lack."""
    return maintain(stream, read, write, factorized.apply_deltas, checkpoint)


def maintain_key_counts(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Shared key counts from inserted keys (k)."""
    return maintain(stream, read, write, ranges.insert_shared, checkpoint)


def windowed_sums(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes", every: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by event type in windows of ``ts``; later rows than ``late`` are dropped."""
    window = F.window("ts", width, every) if every else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def reserve(stream: DataFrame, quota: int) -> DataFrame:
    """Outcomes (shard, seq, outcome) of requests (shard, seq): each shard's stock is keyed state."""

    def serve(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        left = state.get[0] if state.exists else quota
        for pdf in batches:
            pdf = pdf.sort_values("seq")
            ok = min(left, len(pdf))
            left -= ok
            out = pdf[["shard", "seq"]].copy()
            out["outcome"] = ["ok"] * ok + ["soldout"] * (len(pdf) - ok)
            yield out
        state.update((left,))

    return stream.select("shard", "seq").groupBy("shard").applyInPandasWithState(serve, "shard bigint, seq bigint, outcome string", "left bigint", "append", GroupStateTimeout.NoTimeout)
