"""Outliers, the quality report and the column profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlines.functions.expressions import day_text, total
from orderlines.functions.order_statistics import column_quantiles
from orderlines.functions.storage import materialize
from orderlines.operators.cleaning import BAD_TIME, COPIES, NEGATIVE, missing_required
from orderlines.schema import LINE_NO


@dataclass(frozen=True)
class OrderScreen:
    """Order totals with the bounds outside of which an order is an outlier."""

    totals: DataFrame
    lower: float | None
    upper: float | None

    def outliers(self) -> DataFrame:
        amount = F.col("amount").cast("double")
        return self.totals.where((amount < F.lit(self.lower)) | (amount > F.lit(self.upper)))


def screen_orders(lines: DataFrame, approx: bool = False) -> OrderScreen:
    """Interquartile screen of order totals: 1.5 ranges below the first or above the third quartile.

    ``approx`` takes the quartiles from a sketch instead of the exact order.
    """
    totals = materialize(
        lines.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(total(F.col("actual_amount")).alias("amount")),
        "order-totals",
    )
    if approx:
        q1, q3 = totals.agg(
            F.percentile_approx(F.col("amount").cast("double"), [0.25, 0.75]).alias("q")
        ).first()["q"] or (None, None)
    else:
        q1, q3 = column_quantiles(totals, {"amount": [0.25, 0.75]})["amount"]
    if q1 is None:
        return OrderScreen(totals, None, None)
    spread = q3 - q1
    return OrderScreen(totals, q1 - 1.5 * spread, q3 + 1.5 * spread)


def flag_outlier_orders(lines: DataFrame, screen: OrderScreen) -> DataFrame:
    """``is_anomaly`` on every line of an outlying order.

    Lines without an order id are kept out of the join, where they would meet on one key. The outlying orders are written
    first: Spark then knows how few they are before it plans the join, and need not shuffle the lines for it.
    """
    flagged = materialize(screen.outliers().select("order_id"), "outlying-orders").withColumn("_outlier", F.lit(True))
    known = (
        lines.where(F.col("order_id").isNotNull())
        .join(flagged, "order_id", "left")
        .withColumn("is_anomaly", F.coalesce("_outlier", F.lit(False)))
        .drop("_outlier")
    )
    others = lines.where(F.col("order_id").isNull()).withColumn("is_anomaly", F.lit(False))
    return known.unionByName(others)


def quantity_outliers(lines: DataFrame) -> DataFrame:
    """Lines above the 99th percentile of quantity; the reported threshold is cut to an integer."""
    (limit,) = column_quantiles(lines, {"quantity": [0.99]})["quantity"]
    limit = F.lit(limit).cast("double")
    return lines.agg(
        F.first(limit.cast("long"), ignorenulls=True).alias("threshold"),
        F.count_if(F.col("quantity").cast("double") > limit).alias("n_outliers"),
    )


REPORT = T.StructType(
    [
        T.StructField("check", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def quality_report(raw_columns: list[str], distinct: DataFrame, screen: OrderScreen | None = None) -> DataFrame:
    """Findings as rows ``(check, column, value)``.

    ``distinct`` are the filled lines with their copy counts, so one pass over them also yields
    the counts of the raw rows.
    """
    columns = distinct.columns
    copies = F.col(COPIES)
    facts: list[tuple[str, str | None, Column]] = [
        ("raw_rows", None, total(copies)),
        ("clean_rows", None, F.count(F.lit(1))),
        ("duplicates_removed", None, total(copies) - F.count(F.lit(1))),
        # The screen has a row per order already; to count them again would shuffle the lines by order.
        ("total_orders", None, F.count_distinct("order_id") if screen is None else F.lit(screen.totals.count())),
        ("missing_customer_id", "customer_id", F.lit(int("customer_id" not in raw_columns))),
        ("missing_platform", "platform", F.lit(int("platform" not in raw_columns))),
    ]
    facts += [("missing_required", name, F.lit(1)) for name in missing_required(raw_columns)]
    if "date" in columns:
        facts += [
            ("first_date", "date", day_text(F.min("date"))),
            ("last_date", "date", day_text(F.max("date"))),
        ]
    if BAD_TIME in columns:
        facts.append(("bad_times", "order_time", total(F.col(BAD_TIME))))
    facts += [
        ("negative_values", name.removeprefix(NEGATIVE), total(F.col(name)))
        for name in columns
        if name.startswith(NEGATIVE)
    ]
    one_row = distinct.agg(*[value.cast("string").alias(f"_{i}") for i, (_, _, value) in enumerate(facts)])
    report = one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(check).alias("check"),
                        F.lit(column).cast("string").alias("column"),
                        F.col(f"_{i}").alias("value"),
                    )
                    for i, (check, column, _) in enumerate(facts)
                ]
            )
        )
    )
    if screen is not None:
        report = report.unionByName(_amount_findings(screen))
    if "quantity" in columns:
        report = report.unionByName(_quantity_findings(distinct))
    return report


def _amount_findings(screen: OrderScreen) -> DataFrame:
    def bound(value: float | None) -> Column:
        return F.round(F.lit(value).cast("double"), 2).cast("decimal(28,2)").cast("string")

    counted = screen.outliers().agg(F.count(F.lit(1)).cast("string").alias("n"))
    return counted.select(
        F.inline(
            F.array(
                _finding("amount_lower_bound", "actual_amount", bound(screen.lower)),
                _finding("amount_upper_bound", "actual_amount", bound(screen.upper)),
                _finding("amount_outliers", "actual_amount", F.col("n")),
            )
        )
    )


def _quantity_findings(lines: DataFrame) -> DataFrame:
    return quantity_outliers(lines).select(
        F.inline(
            F.array(
                _finding("quantity_threshold", "quantity", F.col("threshold").cast("string")),
                _finding("quantity_outliers", "quantity", F.col("n_outliers").cast("string")),
            )
        )
    )


def _finding(check: str, column: str, value: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(column).alias("column"), value.alias("value")
    )


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: counts, most frequent value, moments and quartiles.

    Numbers have moments, from one plain aggregate; NaN counts as missing. Other types have a most
    frequent value (the smallest on ties). Values are counted column by column, each read alone, so equal values merge
    before the shuffle and a column with few values sends few rows; numbers are counted for their distinct
    values only. ``approx`` takes those, and the quartiles, from sketches, so that no numeric column is counted
    value by value. Times are profiled as text. ``df`` is read several times, so pass one that comes from a table.
    """
    fields = [field for field in df.schema if field.name != LINE_NO]
    numeric = [field.name for field in fields if isinstance(field.dataType, T.NumericType)]
    numbers = {field.name: _number(field) for field in fields if field.name in numeric}
    measures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        **({"nunique": F.approx_count_distinct} if approx else {}),
    }
    whole = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[measure(number).alias(f"{i}_{name}") for i, number in enumerate(numbers.values()) for name, measure in measures.items()],
    ).first()
    counted = [field for field in fields if not (approx and field.name in numeric)]
    by_column = materialize(_value_facts(df, counted), "value-facts")
    if approx:
        found = df.agg(
            *[F.percentile_approx(number, [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, number in enumerate(numbers.values())]
        ).first() if numeric else []
        quartiles = {name: found[i] or [None] * 3 for i, name in enumerate(numeric)}
    else:
        quartiles = column_quantiles(df, {name: [0.25, 0.5, 0.75] for name in numeric}) if numeric else {}

    def measured(name: str, measure: str):
        return whole[f"{numeric.index(name)}_{measure}"] if name in numeric and measure in measures else None

    facts = df.sparkSession.createDataFrame(
        [
            (
                i, field.name, field.dataType.simpleString(), field.name in numeric, whole["rows"],
                *[measured(field.name, m) for m in ("count", "nunique", "mean", "std", "min", "max")],
                *quartiles.get(field.name, [None] * 3),
            )
            for i, field in enumerate(fields)
        ],
        "position int, column string, dtype string, is_number boolean, rows long, n long, about long,"
        "mean double, std double, min double, max double, q25 double, q50 double, q75 double",
    )
    count = F.coalesce("n", "filled", F.lit(0))
    by_column = (
        facts.join(by_column, "column", "left")
        .withColumns({"count": count, "nunique": F.coalesce("about", "distinct", F.lit(0))})
    )
    missing = F.col("rows") - F.col("count")
    words = ~F.col("is_number")
    return (
        by_column.select(
            "position",
            "column",
            "count",
            F.when(words, F.col("nunique")).alias("unique"),
            F.when(words, F.col("top")).alias("top"),
            F.when(words, F.col("freq")).alias("freq"),
            "mean",
            "std",
            "min",
            "q25",
            "q50",
            "q75",
            "max",
            "dtype",
            missing.alias("missing"),
            F.round(F.try_divide(missing.cast("double"), F.col("rows").cast("double")) * 100, 2).alias("missing_pct"),
            "nunique",
        )
    )


def _value_facts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Rows (column, filled, distinct, freq, top), one per field: its values counted, then summed up."""
    schema = "column string, filled long, distinct long, freq long, top string"
    facts = df.sparkSession.createDataFrame([], schema)
    for field in fields:
        text, number = _cell(field)
        kinds = {"text": text, "number": number}
        is_text = not isinstance(field.dataType, T.NumericType)
        keys = ["text"] if is_text else ["text", "number"]
        counts = df.select(*[kinds[key].alias(key) for key in keys]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        present = F.col("text").isNotNull() if is_text else F.col("text").isNotNull() | F.col("number").isNotNull()
        # The most rows first, of equal ones the smallest text.
        most = F.min(F.when(F.col("text").isNotNull(), F.struct((-F.col("n")).alias("n"), "text")))
        found = counts.where(present).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("filled"), F.count(F.lit(1)).alias("distinct"), most.alias("most")
        )
        facts = facts.unionByName(
            found.select(
                F.lit(field.name).alias("column"), "filled", "distinct",
                (-F.col("most.n")).alias("freq"), F.col("most.text").alias("top"),
            )
        )
    return facts


def _number(field: T.StructField) -> Column:
    """A numeric column as a double, NaN as missing."""
    return F.nanvl(F.col(field.name).cast("double"), F.lit(None).cast("double"))


def _cell(field: T.StructField) -> tuple[Column, Column]:
    """A value of a column as text or number; large numbers as both.

    A double holds whole numbers up to 2 ** 53 exactly. Beyond that the digits tell values apart.
    """
    column, number = F.col(field.name), F.lit(None).cast("double")
    text = column.cast("string")
    if isinstance(field.dataType, T.NumericType):
        number = _number(field)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            text = F.lit(None).cast("string")
        else:
            exact = 2.0**53 / 10 ** getattr(field.dataType, "scale", 0)
            text = F.when(F.abs(number) >= exact, text)
    return text, number


