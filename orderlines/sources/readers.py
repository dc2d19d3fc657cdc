"""Reading platform exports as raw order lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlines.schema import LINE_NO, ORDER_LINE, SOURCE_FILE


def read_orders(
    spark: SparkSession,
    paths: str | list[str],
    format: str = "csv",
    encoding: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Raw order lines of one or many exports, all CSV fields as text.

    Files may differ in header and in charset. Columns are brought to the canonical names per
    header, then the files are united by name. ``encoding`` skips the charset check, which reads
    the files once. ``line_no`` keeps the order of lines within a file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if format == "csv":
        groups = _csv_groups(spark, paths, encoding)
    elif format == "parquet":
        groups = [spark.read.parquet(path) for path in paths]
        return _united(groups)
    else:
        raise ValueError(f"unsupported format: {format}; use csv or parquet")
    return _united(
        [
            spark.read.option("header", True)
            .option("encoding", charset)
            .option("multiLine", multi_line)
            .option("enforceSchema", False)
            .csv(files)
            for charset, files in groups
        ]
    )


def read_typed_orders(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Order lines from CSV files in the canonical layout, as ``write_csv`` leaves them."""
    return (
        spark.read.schema(ORDER_LINE)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        .csv(paths)
    )


def _united(frames: list[DataFrame]) -> DataFrame:
    from orderlines.operators.cleaning import normalize_columns

    def placed(frame: DataFrame) -> DataFrame:
        """Position and file, unless the lines have theirs from an earlier read."""
        found = {LINE_NO: F.monotonically_increasing_id(), SOURCE_FILE: F.col("_metadata.file_path")}
        lines = normalize_columns(frame)
        return lines.select("*", *[column.alias(name) for name, column in found.items() if name not in lines.columns])

    named = [placed(frame) for frame in frames]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), named)


def _csv_groups(
    spark: SparkSession, paths: list[str], encoding: str | None
) -> list[tuple[str, list[str]]]:
    """Files that can be read together: same charset and same header line.

    The groups are made on the cluster; a group keeps the list of its files, which names the files
    for the reader. Reading a charset that Spark does not list needs
    ``spark.sql.legacy.javaCharsets``, which is set for the session then.
    """
    files = _inspect(spark, paths, check_charset=encoding is None)
    charset = F.lit(encoding) if encoding else F.when(F.col("utf8"), "UTF-8").when(F.col("gbk"), "GBK")
    groups = (
        files.groupBy(charset.alias("charset"), "header")
        .agg(F.array_sort(F.collect_list("file")).alias("files"))
        .orderBy("charset", "header")
        .collect()
    )
    unknown = [name for row in groups if row["charset"] is None for name in row["files"]]
    if unknown:
        raise ValueError(f"cannot decode {', '.join(unknown)}: neither UTF-8 nor GBK")
    if any(row["charset"].upper() not in _BUILT_IN_CHARSETS for row in groups):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return [(row["charset"], row["files"]) for row in groups]


_BUILT_IN_CHARSETS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def _inspect(spark: SparkSession, paths: list[str], check_charset: bool) -> DataFrame:
    """Per file: header bytes, and whether every line is strict UTF-8 or strict GBK.

    The text source hands on the bytes of a line undecoded, so the check runs on the splits of
    each file in parallel and gives one row per file. The different verdicts on a file's lines, four at most, are gathered
    as a set, which Spark merges in a hash table with one entry per file of a split; it would sort all lines by file for
    the header's text alone.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    raw = F.col("value").cast("binary")
    header = F.min_by(F.base64(raw), F.when(F.col("block") == 0, F.col("row")))
    verdict = F.struct(F.lit(True).alias("utf8"), F.lit(True).alias("gbk"))
    if check_charset:
        single_bytes = F.decode(raw, "ISO-8859-1")
        rest = F.regexp_replace(
            single_bytes, "[\\x00-\\x7F]+|[\\x81-\\xFE][\\x40-\\x7E\\x80-\\xFE]", ""
        )
        verdict = F.struct(F.is_valid_utf8("value").alias("utf8"), (rest == "").alias("gbk"))
    files = lines.groupBy("file").agg(header.alias("header"), F.collect_set(verdict).alias("found"))
    return files.select(
        "file", "header", F.forall("found", lambda x: x["utf8"]).alias("utf8"), F.forall("found", lambda x: x["gbk"]).alias("gbk")
    )
