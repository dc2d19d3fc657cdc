"""Shared helpers: reading tables, and running Arrow functions over whole texts.

Every operator treats a null text as empty unless it says otherwise, reads whole texts, and takes
the names of the text and key columns. Columns that the caller asks to keep pass through; where a
kept column has the name of a result, the result replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of a batch function gets at most, beyond its first row.
BATCH_BYTES = 1 << 20
#: Bytes that Spark sends to Python at once after ``small_batches``, and the setting.
SENT_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BYTES = "_text_bytes"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out_remainder(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark sends to Python at once by bytes, where whole texts pass through.

    By default a batch is 10,000 rows or 64 MB, and a running task holds several copies of it outside the heap, in the JVM
    and in its worker. The bound is a setting of the session and reaches batches above it only.
    """
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if bound > SENT_BYTES:
        spark.conf.set(BATCH_SETTING, str(SENT_BYTES))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_BYTES of text; a longer text stands alone."""
    start, size = 0, 0
    for row, length in enumerate(pc.binary_length(texts).to_pylist()):
        length = length or 0
        if row > start and size + length > BATCH_BYTES:
            yield start, row
            start, size = row, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    function: Callable[[list[bytes | None]], list],
    results: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Add columns that ``function`` computes from lists of whole UTF-8 texts.

    ``function`` returns one sequence or Arrow array per column of the DDL string ``results``.
    """
    added = T._parse_datatype_string(results)
    kept = [name for name in keep if name not in added.names]
    # A kept text goes to Python and back once, as the bytes that the function reads.
    sent = text in kept and isinstance(df.schema[text].dataType, T.StringType)
    at = kept.index(text) if sent else len(kept)
    columns_sent = [F.col(f"`{name}`").cast("binary").alias(name) if sent and name == text else F.col(f"`{name}`") for name in kept]
    if not sent:
        columns_sent.append(F.col(f"`{text}`").cast("binary").alias(TEXT_BYTES))
    source = df.select(*columns_sent)
    schema = T.StructType([source.schema[name] for name in kept] + added.fields)
    arrow = to_arrow_schema(schema)
    types = [arrow.field(i).type for i in range(len(kept), len(arrow))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for start, stop in slices(texts):
                columns = function(texts.slice(start, stop - start).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, types)]
                passed = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(passed + arrays, names=schema.names)

    made = source.mapInArrow(run, schema)
    return made.withColumn(text, F.col(f"`{text}`").cast("string")) if sent else made
