"""Column expressions shared by the operators. Everything here stays inside Spark's codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlines.schema import LINE_NO, MONEY, REFUNDED


def parse_time(text: Column) -> Column:
    """Wall-clock time from export text; null when it is no time.

    Slashed, dotted and compact dates are brought to ISO order first. ``try_cast`` then takes
    date-only values, ``T`` or blank separators, missing seconds and fractions.
    """
    text = F.trim(text)
    text = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    text = F.regexp_replace(text, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=[ T]|$)", "$1-$2-$3")
    return text.try_cast("timestamp_ntz")


def parse_amount(value: Column) -> Column:
    """Exact decimal from text or number; null when it is no number."""
    return value.try_cast(MONEY)


def not_negative(value: Column) -> Column:
    """Zero for negatives. ``greatest`` would turn a null into zero."""
    return F.when(value < 0, F.lit(0).cast(MONEY)).otherwise(value)


def calendar_columns(time: Column) -> dict[str, Column]:
    """Date, hour, weekday (Monday is 0) and weekend flag of a time."""
    return {
        "date": F.to_date(time),
        "hour": F.hour(time),
        "weekday": F.weekday(time),
        "is_weekend": weekend_flag(F.weekday(time)),
    }


def with_calendar(lines: DataFrame) -> DataFrame:
    """Lines with date, hour, weekday and weekend flag, those that are missing from ``order_time``."""
    if "order_time" not in lines.columns:
        return lines
    parts = calendar_columns(F.col("order_time"))
    return lines.withColumns({name: part for name, part in parts.items() if name not in lines.columns})


def weekend_flag(weekday: Column) -> Column:
    return F.coalesce((weekday >= 5).cast("int"), F.lit(0))


def total(value: Column) -> Column:
    """Sum in which a group without values counts as zero."""
    return F.coalesce(F.sum(value), F.lit(0))


def mean(value: Column) -> Column:
    """Mean as a double; the sum stays an exact decimal until the one division."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return share if digits is None else F.round(share, digits)


def refunded_lines() -> Column:
    return F.count_if(F.col("status") == REFUNDED)


def first_value(df: DataFrame, column: str) -> Column:
    """First non-null value of a group in source order; ties fall to the smaller value."""
    value = F.col(column)
    order = [F.col(LINE_NO), value] if LINE_NO in df.columns else [value]
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


#: Numbers of 32 bits, the upper half negative; and a position before all others.
_SPAN, _HALF, _BEFORE = Decimal(2**32), Decimal(2**31), Decimal(-(2**63) - 1)


def can_place(df: DataFrame, column: str) -> bool:
    """Whether ``placed_number`` takes the column: whole numbers of at most 32 bits, with whole positions."""
    small = isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType))
    return small and (LINE_NO not in df.columns or isinstance(df.schema[LINE_NO].dataType, T.IntegralType))


def placed_number(df: DataFrame, column: str) -> Column:
    """Position and value as one exact number. Its minimum in a group holds the ``first_value``, as ``number_in`` reads it.

    Spark merges such a minimum in a hash table; for ``first_value`` it sorts the rows.
    """
    position = F.coalesce(F.col(LINE_NO).cast("decimal(20,0)"), F.lit(_BEFORE)) if LINE_NO in df.columns else F.lit(Decimal(0))
    return (position * F.lit(_SPAN) + F.col(column)).cast("decimal(38,0)")


def number_in(placed: Column) -> Column:
    return (F.pmod(placed + F.lit(_HALF), F.lit(_SPAN)) - F.lit(_HALF)).cast("int")


def day_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
