"""Benchmark records: JSON source and sinks, text and markdown."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_ns, ns_per_op

SCHEMA = "experiment string, variant string, n bigint, params string, median_ns decimal(38,0), p99_ns decimal(38,0), min_ns decimal(38,0), mean_ns double, iters int, ops bigint, bytes_touched bigint, extra string, notes string"


def read_records(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Records of a JSON file, an array or one a line; empty if there is none."""
    try:
        return spark.read.schema(SCHEMA).option("multiLine", array).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def lines(records: DataFrame) -> DataFrame:
    """A line of text for each record."""
    return records.select(F.concat_ws("  ", F.rpad("experiment", 20, " "), F.rpad("variant", 32, " "), F.concat(F.lit("n="), "n"), format_ns("median_ns"), F.concat(F.round(ns_per_op("median_ns", "ops"), 3), F.lit(" ns/op"))).alias("line"))


def markdown(records: DataFrame) -> DataFrame:
    """The body of a markdown table, in order of experiment and variant: part, line."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "experiment", "variant", "n", format_ns("median_ns"), format_ns("p99_ns"), F.round(ns_per_op("median_ns", "ops"), 3)), F.lit(" |"))
    return records.orderBy("experiment", "variant", "n").select("experiment", cells.alias("line"))


def write_markdown(records: DataFrame, path: str) -> None:
    markdown(records).coalesce(1).select("line").write.mode("overwrite").text(path)
