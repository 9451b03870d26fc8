"""State that outlives a query: tables built once from their inputs, asked many times, built anew when an input changes."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh folder where it is unset, on one machine only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparelane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of what is at ``paths``: time of the last change, number and size of the files."""
    said = ""
    for path in paths:
        p, fs = _path(spark, path)
        size = fs.getContentSummary(p)
        said += f"{path} {fs.getFileStatus(p).getModificationTime()} {size.getFileCount()} {size.getLength()} "
    return hashlib.sha256(said.encode()).hexdigest()[:32]


def stored(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` that ``build`` makes of the files at ``paths``, as read from the shared folder.

    Whoever asks first writes it; a half-written table is never seen, and of two writers one wins.
    """
    folder = f"{shared_root(spark)}/sparelane-state"
    path = f"{folder}/{name}-{version(spark, paths)}"
    there, fs = _path(spark, path)
    if not fs.exists(there):
        made = f"{folder}/.{uuid.uuid4().hex}"
        build().write.parquet(made)
        source, _ = _path(spark, made)
        if fs.exists(there) or not fs.rename(source, there):
            fs.delete(source, True)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all stored tables."""
    p, fs = _path(spark, f"{shared_root(spark)}/sparelane-state")
    fs.delete(p, True)
