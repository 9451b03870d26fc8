"""Corpus pipeline: quality, line deduplication, near duplicates, decontamination, pieces.

Each stage reads the documents that the one before it kept, as Parquet, and returns the columns
of ``documents``; the last adds the token ids. A stage's rows are those of its input that it
keeps:

* quality: documents that importance resampling keeps;
* line_dedup: text less the lines of recurring templates, with n_chars to match; documents that
  lose all of their text go, documents that were empty before stay;
* near_duplicates: of each group of near duplicates the smallest doc_id;
* decontaminate: documents without a benchmark window;
* pieces: all, with n_tokens, token_ids and round_trip.

Decisions are on rows: those that share a doc_id, or have none, stay or go each for itself, and of
equal rows in a group of near duplicates one stays. Nulls and empty tables are as the operators define
them. A stage's result must be written before the next stage begins, which deletes the inner tables
that the result is read from.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparelane.llm import decontaminate, line_templates, ngram_join, pieces, quality, scratch
from sparelane.llm._tables import bounded, keyed, table
from sparelane.llm.queries import piece_model
from sparelane.llm.scratch import materialize


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Inner tables of the stage that ended last.
_inner: list[str] = []


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.discard(spark, _inner)
        _inner.clear()
        scratch.compact(spark)
        scratch.taken()  # what others wrote is theirs
        out = f(spark, docs, sf_dir)
        _inner.extend(scratch.taken())
        return out

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """The row as one struct, so that no column of the input meets an operator's own."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))


def _without(docs: DataFrame, key: Column, rows: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``rows`` (row)."""
    found = docs.select(F.struct(*docs.columns).alias("__row"), key.alias("__key"))
    gone = bounded(materialize(rows.select("row"), "gone"))
    return found.join(gone, F.col("__key") == F.col("row"), "left_anti").select("__row.*")


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.resample(_packed(docs), table(spark, sf_dir, "labels"), columns=["__row"])
    return scored.filter(quality.KEPT).select("__row.*")


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_templates.drop_lines(_packed(docs)).filter(~F.col("emptied"))
    row = {c: F.col("__row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(row[c].alias(c) for c in docs.columns))


@_stage
def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = keyed(docs)
    found = materialize(ngram_join.jaccard_components(docs, size=5, percent=75, row=key).filter("class is not null"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = found.groupBy("class").agg(F.min(order)["row"].alias("first"), F.count("*").alias("k")).filter("k > 1")
    return _without(docs, key, found.join(first, "class").filter(F.col("row") != F.col("first")))


@_stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = keyed(docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=10, row=key)
    return _without(docs, key, found.filter("contaminated"))


@_stage
def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("pieces", piece_stage),
]

#: SQL can express neither the classifier nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
