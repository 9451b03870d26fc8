"""Streaming forms give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparelane.operators import factorized, ranges
from sparelane.streaming import maintained


class Store:
    """A state table of versioned folders."""

    def __init__(self, spark, root, first):
        self.spark, self.root, self.seen = spark, root, -1
        first.write.parquet(f"{root}/-1")

    def read(self):
        return self.spark.read.parquet(f"{self.root}/{self.seen}")

    def write(self, df, epoch):
        if epoch > self.seen:
            df.write.mode("overwrite").parquet(f"{self.root}/{epoch}")
            self.seen = epoch


def run(query):
    query.processAllAvailable()
    query.stop()


def test_signed_deltas_maintain_pair_sums(spark, tmp_path):
    a, b = (spark.createDataFrame(r, "g int, v bigint") for r in ([(1, 2), (2, 3)], [(1, 10), (2, 20)]))
    store = Store(spark, tmp_path / "state", factorized.build_state(a, b))
    deltas = [(1, "A", 2, -1), (1, "A", 5, 1), (3, "B", 4, 1), (2, "B", 20, -1)]
    frame = spark.createDataFrame(deltas, "g int, side string, v bigint, sign int")
    frame.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(maintained.maintain_pair_sums(stream, store.read, store.write, str(tmp_path / "cp")))
    expected = {tuple(r) for r in factorized.result(factorized.apply_deltas(factorized.build_state(a, b), frame)).collect()}
    assert {tuple(r) for r in factorized.result(store.read()).collect()} == expected


def test_inserted_keys_maintain_counts(spark, tmp_path):
    keys = spark.createDataFrame([(1,), (1,), (7,)], "k bigint")
    store = Store(spark, tmp_path / "state", ranges.shared_state(keys))
    spark.createDataFrame([(1,), (9,)], "k bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k bigint").parquet(str(tmp_path / "in"))
    run(maintained.maintain_key_counts(stream, store.read, store.write, str(tmp_path / "cp")))
    assert {tuple(r) for r in store.read().collect()} == {(1, 3), (7, 1), (9, 1)}


def test_windows_and_keyed_stock(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    run(maintained.windowed_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert {(r.n, r.total) for r in spark.sql("SELECT * FROM sums").collect()} == {(2, 3.0), (1, 4.0)}
    req = spark.createDataFrame([(i, i % 2) for i in range(10)], "seq bigint, shard bigint")
    req.write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "r"))
    run(maintained.reserve(stream, 3).writeStream.outputMode("append").format("memory").queryName("served").option("checkpointLocation", str(tmp_path / "c2")).start())
    got = {(r.seq, r.outcome) for r in spark.sql("SELECT * FROM served").collect()}
    assert got == {(i, "ok" if i < 6 else "soldout") for i in range(10)}
