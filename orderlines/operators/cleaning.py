"""Normalization and cleaning of raw exports into order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlines.functions.expressions import (
    calendar_columns,
    not_negative,
    parse_amount,
    parse_time,
)
from orderlines.schema import (
    CALENDAR_COLUMNS,
    COMPLETED,
    HEADER_ALIASES,
    LINE_NO,
    MONEY,
    NUMERIC_COLUMNS,
    OTHER_CATEGORY,
    REQUIRED_COLUMNS,
    SOURCE_FILE,
    UNKNOWN_PLATFORM,
)

COPIES = "_copies"
BAD_TIME = "_bad_time"
NEGATIVE = "_negative_"


def resolve_headers(headers: list[str]) -> dict[str, str]:
    """Source header of each canonical column that the export carries.

    Headers are compared trimmed and without case; the first in file order wins, except that the
    canonical name itself goes before its aliases.
    """
    folded = [(header, header.strip().lower()) for header in headers]
    found = {}
    for name, aliases in HEADER_ALIASES.items():
        accepted = {alias.lower() for alias in aliases}
        matches = [header for header, text in folded if text in accepted]
        exact = [header for header in matches if header.strip().lower() == name]
        if matches:
            found[name] = (exact or matches)[0]
    return found


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Rename aliased headers to the canonical names; other columns pass through."""
    new_names = {header: name for name, header in resolve_headers(raw.columns).items()}
    return raw.select(
        *[_quoted(header).alias(new_names.get(header, header)) for header in raw.columns]
    )


def missing_required(columns: list[str]) -> list[str]:
    return [name for name in REQUIRED_COLUMNS if name not in columns]


def coerce(lines: DataFrame) -> DataFrame:
    """Typed lines: times parsed, numbers made decimal and not negative, platform present.

    Hidden flag columns keep what the quality report counts.
    """
    columns = lines.columns
    parsed: dict[str, Column] = {name: _quoted(name) for name in columns}
    flags: dict[str, Column] = {}
    if "order_time" in columns:
        parsed["order_time"] = parse_time(F.col("order_time").cast("string"))
        for name in CALENDAR_COLUMNS:
            parsed.pop(name, None)
        flags[BAD_TIME] = parsed["order_time"].isNull()
    elif "date" in columns:
        parsed["date"] = F.col("date").try_cast("date")
    for name in NUMERIC_COLUMNS:
        if name in columns:
            number = parse_amount(F.col(name))
            parsed[name] = not_negative(number)
            flags[NEGATIVE + name] = F.coalesce(number < 0, F.lit(False))
    if "platform" not in columns:
        parsed["platform"] = F.lit(UNKNOWN_PLATFORM)
    return lines.select(
        *[column.alias(name) for name, column in parsed.items()],
        *[column.cast("long").alias(name) for name, column in flags.items()],
    )


def deduplicate(coerced: DataFrame) -> DataFrame:
    """One row per distinct line, with how often it occurred and the sums of its flags.

    Equal rows are merged before the shuffle. Where a row was found (position and file) is no part
    of it, so overlapping exports count once; the first of each is kept.
    """
    flags = [name for name in coerced.columns if name == BAD_TIME or name.startswith(NEGATIVE)]
    place = [name for name in (LINE_NO, SOURCE_FILE) if name in coerced.columns]
    data = [name for name in coerced.columns if name not in flags and name not in place]
    kept = [F.min(name).alias(name) for name in place]
    return coerced.groupBy(*[_quoted(name) for name in data]).agg(
        F.count(F.lit(1)).alias(COPIES), *[F.sum(name).alias(name) for name in flags], *kept
    )


def fill(distinct: DataFrame) -> DataFrame:
    """Missing values and columns filled; calendar columns added."""
    columns = distinct.columns
    lines = distinct
    if "category" in columns:
        lines = lines.na.fill({"category": OTHER_CATEGORY})
    if "quantity" in columns:
        lines = lines.withColumn("quantity", F.coalesce("quantity", F.lit(1).cast(MONEY)))
    if {"unit_price", "total_amount", "quantity"} <= set(columns):
        derived = F.try_divide("total_amount", "quantity").try_cast(MONEY)
        lines = lines.withColumn("unit_price", F.coalesce("unit_price", derived))
    if {"actual_amount", "total_amount"} <= set(columns):
        lines = lines.withColumn("actual_amount", F.coalesce("actual_amount", "total_amount"))
    zero = F.lit(0).cast(MONEY)
    if "discount" in columns:
        lines = lines.withColumn("discount", F.coalesce("discount", zero))
    refund = F.coalesce("refund_amount", zero) if "refund_amount" in columns else zero
    lines = lines.withColumn("refund_amount", refund)
    if "actual_amount" not in columns and {"total_amount", "discount"} <= set(columns):
        lines = lines.withColumn(
            "actual_amount", (F.col("total_amount") - F.col("discount")).cast(MONEY)
        )
    if "status" not in columns:
        lines = lines.withColumn("status", F.lit(COMPLETED))
    if "customer_id" not in columns:
        lines = lines.withColumn("customer_id", F.col("order_id"))
    if "order_time" in columns:
        lines = lines.withColumns(calendar_columns(F.col("order_time")))
    return lines


def visible(lines: DataFrame) -> DataFrame:
    """Drop the flag and count columns that only the quality report reads."""
    return lines.drop(*[n for n in lines.columns if n in (COPIES, BAD_TIME) or n.startswith(NEGATIVE)])


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
