from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def told_apart(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: 0 if every id is there and unique, else a hash of the text."""
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count() == 0
    return F.lit(0).cast("long") if unique else F.xxhash64("text")


def keyed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and a key of each of its rows: the place in its file, which a second scan gives again. Frames without files are written first."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = materialize(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at"))


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has so many rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
