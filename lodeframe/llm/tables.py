"""Shared-folder tables: how the operators cut lineage."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: bytes of an Arrow batch while an operator writes a table: texts are long, and a batch stands in the JVM and in Python at once
BATCH = 16 << 20

_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lodeframe-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder if all run in this process; on a cluster an error, as no
    folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_dir()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer in use."""
    spark.sparkContext._jvm.java.lang.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at the end, come what may, but for those that are kept: these go to the scope around."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            drop(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", BATCH
    before = spark.conf.get(key, None)
    if before is not None and before.isdigit():
        most = min(most, int(before))
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder, and read again.

    A replicated or remote folder makes the table outlive any executor, and what
    builds on it no longer recomputes the plan above. `keep` is for results: they outlive the
    innermost scope.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodeframe-{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    if scopes[:-1] if keep else scopes:
        scopes[-2 if keep else -1].append(path)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of df's size, from its files; 0 where it knows nothing and assumes the most."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 56 else 0


def fits(df: DataFrame) -> bool:
    """Whether df is within the session's bound for broadcasts."""
    most = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(most[-1:], 0)
    return 0 < planned_bytes(df) <= int(most.rstrip("kmg")) << unit
