"""Intermediate tables: written to the cluster's shared folder, or kept by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()
_KEPT: WeakKeyDictionary[SparkSession, list[DataFrame]] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it, or None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else None


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call returns: in the shared folder, else in the warehouse."""
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{folder}/orderlines-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Do the work of ``df`` once, for frames that several later jobs read.

    With a shared folder it is written there as Parquet and a scan is returned: the lineage is cut,
    a lost executor costs nothing but its running tasks, column pruning and filter pushdown stay,
    and the file sizes let Spark choose join strategies. Without one the frame is persisted on
    memory and disk, and what an executor loses is computed again. ``release`` removes either.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        _KEPT.setdefault(spark, []).append(kept)
        return kept
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, mark: tuple[int, int]) -> DataFrame:
    """``materialize`` a result and delete the intermediates made since ``mark``, a result of ``marked``.

    For operators with large intermediates and a small result that others go on from.
    """
    spark = df.sparkSession
    result = materialize(df, name)
    if shared_folder(spark) is None:
        result.count()
    written, kept = _WRITTEN.get(spark, []), _KEPT.get(spark, [])
    ends = len(written) - (shared_folder(spark) is not None), len(kept) - (shared_folder(spark) is None)
    _delete(spark, written[mark[0] : ends[0]], kept[mark[1] : ends[1]])
    del written[mark[0] : ends[0]], kept[mark[1] : ends[1]]
    return result


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a job are deleted when the job ends.

    Otherwise they stay until the driver collects its garbage, which may not be before the session ends.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def marked(spark: SparkSession) -> tuple[int, int]:
    """The number of intermediates so far."""
    return len(_WRITTEN.get(spark, [])), len(_KEPT.get(spark, []))


def release(spark: SparkSession) -> None:
    """Delete what ``materialize`` and ``new_path`` have left so far in this session.

    Call it when the results that were built on them have been used.
    """
    _delete(spark, _WRITTEN.pop(spark, []), _KEPT.pop(spark, []))


def _delete(spark: SparkSession, written: list[str], kept: list[DataFrame]) -> None:
    for frame in kept:
        frame.unpersist()
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in written:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(configuration).delete(target, True)
