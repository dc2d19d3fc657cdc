"""Writing order lines and customer profiles, and laying lines out by order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderlines.functions.storage import new_path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header line; one file per task."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by date, so that date filters skip whole folders.

    The rows are spread by ``rebalance`` first: a few files per date, and a date that holds much
    of the data is split over several tasks.
    """
    df.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def write_bucketed(
    lines: DataFrame, table: str, buckets: int = 200, path: str | None = None, dealt: bool = False, compression: str | None = None
) -> DataFrame:
    """Lines as a table in ``buckets`` files by ``order_id``, sorted in each; returns the table.

    ``dealt`` lines come in ``buckets`` partitions by ``order_id``, or a multiple, and are written as they are.
    ``compression`` is Parquet's; the session's if not given.

    Order rollups, order features and order totals of it need no shuffle. Choose the buckets by size: a bucket is
    one task, some hundred MB of it fit well. All lines of an order share a bucket, so data with an order that
    holds a large part of all lines are better left as they are.
    """
    spark = lines.sparkSession
    rows = lines if dealt else lines.repartition(buckets, "order_id")
    writer = rows.write.bucketBy(buckets, "order_id").sortBy("order_id").option("path", path or new_path(spark, table))
    if compression:
        writer = writer.option("compression", compression)
    writer.saveAsTable(table)
    return spark.table(table)
