"""Intermediate tables in the shared checkpoint folder, and caches of Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sparkdraft.session import ensure_checkpoint_dir


_WRITTEN: list[str] = []


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes ``df`` once; the files
    survive a lost executor. Row order is not kept. ``drop_stored`` deletes
    the files once the results that read them have been written.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` returned and nothing reads any more."""
    _WRITTEN.remove(df._stored_at)
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries built and run in this block go when each is done,
    not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written in this process; returns how many there were."""
    hadoop, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process.

    Functions are shipped by value, so a global of this package would start
    empty in every task; the dict hangs on an imported module instead.
    """
    import pyspark

    return pyspark.__dict__.setdefault("_sparkdraft_worker_cache", {})
