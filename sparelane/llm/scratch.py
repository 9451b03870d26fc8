"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh folder where it is unset, on one machine only (tests, local mode)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparelane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return it as read from there.

    A lost executor then costs a re-read, not the whole lineage, and a table that
    two later steps need is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sparelane/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Folders written since the last :func:`taken`.
_written: list[str] = []


def taken() -> list[str]:
    """The folders written since the last call, for whoever ends their use."""
    out = list(_written)
    _written.clear()
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t.scratch_path])


def discard(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these folders, or every table of :func:`materialize`; frames that read them are void afterwards."""
    _delete(spark, [f"{shared_root(spark)}/sparelane"] if paths is None else paths)


#: What operators keep in a worker between tasks, by name.
KEPT: dict[str, dict] = {}


#: Seconds without a task after which a worker gives up all that it keeps.
IDLE_S = 1.0
_idle: list[threading.Timer] = []


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _give_up() -> None:
    for kept in KEPT.values():
        kept.clear()
    _give_back()


def tidy(run: Callable, keep: str = "") -> Callable:
    """A function for mapInArrow whose worker gives memory back at the end: workers wait for later tasks, beside the JVM.

    Workers serve one operator after another; what others kept goes at the beginning. More workers than
    tasks may wait, and no task reaches those: what a worker kept itself goes once it has waited for ``IDLE_S``.
    """

    def to_the_end(batches: Iterable) -> Iterator:
        while _idle:
            _idle.pop().cancel()
        for name, kept in KEPT.items():
            if name != keep:
                kept.clear()
        try:
            yield from run(batches)
        finally:
            _give_back()
            if any(KEPT.values()):
                _idle.append(threading.Timer(IDLE_S, _give_up))
                _idle[-1].daemon = True
                _idle[-1].start()

    return to_the_end


def compact(spark: SparkSession) -> None:
    """Executors collect their garbage, after which a JVM gives back most of the heap that it no longer needs.

    Else it keeps the largest heap that it ever had beside the Python workers. A task a core reaches each executor while no
    other job runs; the second round frees what the first one's own tasks still held.
    """
    n = spark.sparkContext.defaultParallelism
    for _ in range(2):
        spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
