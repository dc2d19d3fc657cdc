"""Business metrics of order lines.

Distinct counts go through ``order_grain``: lines are first merged per group, order and customer,
which sums on the map side, spreads a large group over all tasks and leaves few rows for the
distinct counts. Groups without a key are left out. Daily results have at most one row per
calendar day and series, which is what the windows run over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlines.functions.expressions import (
    day_text,
    first_value,
    mean,
    percent,
    refunded_lines,
    total,
    weekend_flag,
    with_calendar,
)
from orderlines.functions.order_statistics import Ordering
from orderlines.functions.storage import materialize
from orderlines.schema import LINE_NO, REFUNDED, WEEKDAY_NAMES


def order_rollup(lines: DataFrame, merge_first: bool = False) -> DataFrame:
    """One row per order: first values of its attributes, sums, and number of lines.

    By default the lines are dealt by order first: orders have few lines, and one sort then serves both steps of the
    aggregate. With ``merge_first`` every task merges its lines of an order before the shuffle: a first value is
    the minimum of (position, value), which merges like a sum. An order with very many lines then reaches the last step as
    one row per task, at the cost of a second, smaller sort; lines from a table of ``write_bucketed`` are not shuffled at all.
    """
    lines = with_calendar(lines)
    known = lines.where(F.col("order_id").isNotNull())
    if not merge_first:
        known = known.repartition("order_id")
    return known.groupBy("order_id").agg(
        *[first_value(lines, c).alias(c) for c in ("date", "customer_id", "platform", "status")],
        *[total(F.col(c)).alias(c) for c in ("total_amount", "actual_amount", "discount", "refund_amount")],
        F.count("product_name").alias("item_count"),
    )


def order_grain(lines: DataFrame, *group: str) -> DataFrame:
    """Lines merged per group, order and customer."""
    return lines.groupBy(*group, "order_id", "customer_id").agg(
        total(F.col("actual_amount")).alias("amount"),
        total(F.col("total_amount")).alias("gross"),
        total(F.col("discount")).alias("discount"),
        F.count(F.lit(1)).alias("lines"),
        refunded_lines().alias("refunded"),
    )


def _mean_order_value() -> Column:
    in_orders = F.sum(F.when(F.col("order_id").isNotNull(), F.col("amount")))
    return F.try_divide(in_orders.cast("double"), F.count_distinct("order_id").cast("double"))


# ---- overview -------------------------------------------------------------------------------


def customer_days(rollup: DataFrame) -> DataFrame:
    """Order-level sums per day and customer, the base of the overview."""
    return rollup.groupBy("date", "customer_id").agg(
        total(F.col("actual_amount")).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("status") == REFUNDED).alias("refunded_orders"),
        total(F.col("total_amount")).alias("gross"),
        total(F.col("discount")).alias("discount"),
    )


def daily_orders(days: DataFrame) -> DataFrame:
    """Order-level sums per day; orders without a day form a row of their own."""
    names = ("revenue", "orders", "refunded_orders", "gross", "discount")
    return days.groupBy("date").agg(*[F.sum(name).alias(name) for name in names])


def latest_days(daily: DataFrame) -> DataFrame:
    """The last day with orders against the last such day before it."""
    last_two = daily.where(F.col("date").isNotNull()).orderBy(F.desc("date")).limit(2)
    newest = F.max("date")
    two = F.count(F.lit(1)) == 2
    today = F.max_by("revenue", "date").cast("double")
    before = F.when(two, F.min_by("revenue", "date").cast("double")).otherwise(F.lit(0.0))
    change = F.when(two, (today - before) / (before + 0.01) * 100).otherwise(F.lit(0.0))
    return last_two.agg(
        day_text(newest).alias("today"),
        today.alias("today_revenue"),
        F.max_by("orders", "date").alias("today_orders"),
        before.alias("yesterday_revenue"),
        F.round(change, 2).alias("dod_change"),
    )


def revenue_distribution(daily: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, population skewness and excess kurtosis of daily revenue."""
    revenue = F.col("revenue").cast("double")
    return daily.where(F.col("date").isNotNull()).agg(
        F.round(F.avg(revenue), 2).alias("mean"),
        F.round(F.median(revenue), 2).alias("median"),
        F.round(F.stddev_samp(revenue), 2).alias("std"),
        F.round(F.skewness(revenue), 2).alias("skewness"),
        F.round(F.kurtosis(revenue), 2).alias("kurtosis"),
    )


def overview(lines: DataFrame) -> DataFrame:
    """The headline numbers in one row, with the revenue distribution as a struct.

    The lines are read once: sums per customer and day are written, and all numbers follow from
    them.
    """
    days = materialize(customer_days(order_rollup(lines, merge_first=True)), "customer-days")
    daily = materialize(daily_orders(days), "days")
    revenue, orders = F.sum("revenue").cast("double"), F.sum("orders").cast("double")
    customers = days.agg(F.count_distinct("customer_id")).scalar()
    latest = latest_days(daily)
    latest = latest.agg(F.first(F.struct(*latest.columns))).scalar()
    stats = revenue_distribution(daily)
    stats = stats.agg(F.first(F.struct(*stats.columns))).scalar()
    return (
        daily.agg(
            F.round(revenue, 2).alias("total_revenue"),
            F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
            F.round(F.coalesce(F.try_divide(revenue, orders), F.lit(0.0)), 2).alias("avg_order_value"),
            percent(F.sum("refunded_orders"), F.sum("orders")).alias("refund_rate"),
            F.round(
                F.sum("discount").cast("double") / (F.sum("gross").cast("double") + 0.01) * 100, 2
            ).alias("avg_discount_rate"),
            F.concat_ws(" ~ ", day_text(F.min("date")), day_text(F.max("date"))).alias("date_range"),
        )
        .withColumn("n_customers", customers)
        .withColumn("_latest", latest)
        .withColumn("revenue_stats", stats)
        .select(
            "total_revenue",
            "total_orders",
            "avg_order_value",
            "refund_rate",
            "avg_discount_rate",
            F.round("_latest.today_revenue", 2).alias("today_revenue"),
            F.col("_latest.today_orders").alias("today_orders"),
            F.round("_latest.yesterday_revenue", 2).alias("yesterday_revenue"),
            F.col("_latest.dod_change").alias("dod_change"),
            "revenue_stats",
            F.when(F.col("date_range") == "", "N/A").otherwise(F.col("date_range")).alias("date_range"),
            "n_customers",
        )
    )


# ---- products, categories, platforms --------------------------------------------------------


def _with_total(groups: DataFrame, column: str) -> DataFrame:
    """Groups with the sum of ``column`` over all of them.

    The few groups are written first, so that the sum does not read the lines again.
    """
    written = materialize(groups, "groups")
    return written.withColumn("_all", written.agg(F.sum(column)).scalar())


def product_ranking(lines: DataFrame, by_order: bool = False) -> DataFrame:
    """Units, revenue, orders, price and refunds per product; most sold first.

    The lines are read once: merged per product, category and order they are written, and both the
    sums and the distinct orders are taken from that. Lines ``by_order`` lie in a table of ``write_bucketed``, which
    counts distinct orders without a shuffle; they are read for each of these, and only the sums are written.
    """
    position = F.min(LINE_NO) if LINE_NO in lines.columns else F.lit(0)

    def merged(*keys: str) -> DataFrame:
        return lines.groupBy(*keys).agg(
            position.alias("position"),
            total(F.col("quantity")).alias("quantity"),
            total(F.col("actual_amount")).alias("amount"),
            F.sum("unit_price").alias("prices"),
            F.count("unit_price").alias("n_prices"),
            refunded_lines().alias("refunded"),
        )

    if by_order:
        sums = materialize(merged("product_name", "category"), "product-sums")
        placed, amounts = lines, sums
    else:
        placed = amounts = cells = materialize(merged("product_name", "category", "order_id"), "product-orders")
        sums = cells.groupBy("product_name", "category").agg(
            F.min("position").alias("position"),
            *[F.sum(name).alias(name) for name in ("quantity", "amount", "prices", "n_prices", "refunded")],
        )
    category = F.when(F.col("category").isNotNull(), F.struct("position", "category"))
    per_product = (
        sums.where(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(
            F.min_by("category", category).alias("category"),
            F.sum("quantity").cast("double").alias("total_sold"),
            F.sum("amount").alias("_revenue"),
            F.try_divide(F.sum("prices").cast("double"), F.sum("n_prices").cast("double")).alias("avg_price"),
            F.sum("refunded").alias("refund_count"),
        )
    )
    orders = placed.groupBy("product_name").agg(F.count_distinct("order_id").alias("order_count"))
    everything = amounts.agg(F.sum("amount")).scalar()
    all_orders = placed.agg(F.count_distinct("order_id")).scalar()
    return (
        per_product.join(orders, "product_name")
        .select(
            "product_name",
            "category",
            "total_sold",
            F.col("_revenue").cast("double").alias("total_revenue"),
            "order_count",
            "avg_price",
            "refund_count",
            percent(F.col("order_count"), all_orders).alias("order_penetration"),
            percent(F.col("_revenue"), everything).alias("revenue_share"),
        )
        .orderBy(F.desc("total_sold"), "product_name")
    )


def best_sellers(ranking: DataFrame, n: int = 5) -> DataFrame:
    return ranking.orderBy(F.desc("total_sold"), "product_name").limit(n)


def slow_movers(ranking: DataFrame) -> DataFrame:
    """The least sold fifth of the products, at least one.

    The fifth grows with the catalogue, so it is not gathered by a limit: the row at which it
    begins in the ranking is looked up, and products are compared with it.
    """
    keyed = ranking.withColumn("_order", -F.col("total_sold"))
    ordering = Ordering(keyed, ["_order", "product_name"])
    if ordering.total == 0:
        return ranking
    start = ordering.total - max(1, int(ordering.total * 0.2))
    cut = ordering.at([start])[start]
    order, name = F.lit(cut["_order"]), F.lit(cut["product_name"])
    return keyed.where(
        (F.col("_order") > order) | ((F.col("_order") == order) & (F.col("product_name") >= name))
    ).drop("_order")


def category_breakdown(lines: DataFrame) -> DataFrame:
    """Revenue, orders, products and revenue share per category; largest first."""
    if "category" not in lines.columns:
        return _no_rows(lines, "category")
    per_pair = lines.groupBy("category", "product_name", "order_id").agg(
        total(F.col("actual_amount")).alias("amount")
    )
    per_category = per_pair.groupBy("category").agg(
        F.sum("amount").alias("_revenue"),
        F.count_distinct("order_id").alias("order_count"),
        F.count_distinct("product_name").alias("product_count"),
    )
    return (
        _with_total(per_category, "_revenue")
        .where(F.col("category").isNotNull())
        .select(
            "category",
            F.col("_revenue").cast("double").alias("total_revenue"),
            "order_count",
            "product_count",
            percent(F.col("_revenue"), F.col("_all")).alias("revenue_share"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def category_features(lines: DataFrame) -> DataFrame:
    """Sales, share to one decimal, orders, mean price and mean discount per category."""
    if "category" not in lines.columns:
        return _no_rows(lines, "category")
    per_category = lines.groupBy("category").agg(
        total(F.col("actual_amount")).alias("_sales"),
        F.count_distinct("order_id").alias("total_orders"),
        mean(F.col("unit_price")).alias("avg_price"),
        mean(F.col("discount")).alias("avg_discount"),
    )
    return (
        _with_total(per_category, "_sales")
        .where(F.col("category").isNotNull())
        .select(
            "category",
            F.col("_sales").cast("double").alias("total_sales"),
            percent(F.col("_sales"), F.col("_all"), 1).alias("sales_pct"),
            "total_orders",
            "avg_price",
            "avg_discount",
        )
        .orderBy(F.desc("total_sales"), "category")
    )


def platform_comparison(lines: DataFrame) -> DataFrame:
    """Orders, revenue, order value, line refund rate, customers and share per platform."""
    if "platform" not in lines.columns:
        return _no_rows(lines, "platform")
    per_platform = (
        order_grain(lines.where(F.col("platform").isNotNull()), "platform")
        .groupBy("platform")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.sum("amount").alias("_revenue"),
            F.round(_mean_order_value(), 2).alias("avg_order_value"),
            percent(F.sum("refunded"), F.sum("lines")).alias("refund_rate"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
    )
    return (
        _with_total(per_platform, "_revenue")
        .select(
            "platform",
            "total_orders",
            F.col("_revenue").cast("double").alias("total_revenue"),
            "avg_order_value",
            "refund_rate",
            "unique_customers",
            percent(F.col("_revenue"), F.col("_all")).alias("revenue_share"),
        )
        .orderBy(F.desc("total_revenue"), "platform")
    )


def _no_rows(lines: DataFrame, column: str) -> DataFrame:
    return lines.sparkSession.createDataFrame([], f"{column} string")


# ---- days and hours -------------------------------------------------------------------------


def daily_trend(lines: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Revenue, orders and customers per day, change on the previous day, trailing mean.

    Days are the days with orders; gaps are not filled. ``series`` splits the trend, for example
    by platform.
    """
    series = series or []
    lines = with_calendar(lines)
    daily = (
        order_grain(lines.where(F.col("date").isNotNull()), *series, "date")
        .groupBy(*series, "date")
        .agg(
            F.sum("amount").cast("double").alias("revenue"),
            F.count_distinct("order_id").alias("orders"),
            F.count_distinct("customer_id").alias("customers"),
        )
    )
    days = Window.partitionBy(*series).orderBy("date")
    previous = F.lag("revenue").over(days)
    return (
        daily.withColumn("prev_revenue", previous)
        .withColumn(
            "dod_pct",
            F.round(F.try_divide(F.col("revenue") - F.col("prev_revenue"), "prev_revenue") * 100, 2),
        )
        .withColumn("ma7", F.avg("revenue").over(days.rowsBetween(-6, 0)))
    )


def daily_features(lines: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Per day: sums, rates, calendar fields and trailing means of revenue and orders."""
    series = series or []
    lines = with_calendar(lines)
    gross = F.sum("gross").cast("double")
    daily = (
        order_grain(lines.where(F.col("date").isNotNull()), *series, "date")
        .groupBy(*series, "date")
        .agg(
            F.sum("amount").cast("double").alias("total_revenue"),
            F.count_distinct("order_id").alias("total_orders"),
            _mean_order_value().alias("avg_order_value"),
            F.count_distinct("customer_id").alias("total_customers"),
            (F.sum("refunded") / F.sum("lines")).alias("refund_rate"),
            (F.sum("discount").cast("double") / (gross + 0.01)).alias("discount_rate"),
        )
    )
    week = Window.partitionBy(*series).orderBy("date").rowsBetween(-6, 0)
    return daily.withColumns(
        {
            "weekday": F.weekday("date"),
            "is_weekend": weekend_flag(F.weekday("date")),
            "month": F.month("date"),
            "day_of_month": F.dayofmonth("date"),
            "week_of_year": F.weekofyear("date"),
            "revenue_ma7": F.avg("total_revenue").over(week),
            "orders_ma7": F.avg("total_orders").over(week),
        }
    )


def hourly_orders(lines: DataFrame) -> DataFrame:
    """Mean orders per weekday and hour, over the dates that had an order in that hour."""
    lines = with_calendar(lines)
    cells = (
        lines.where(F.col("date").isNotNull() & F.col("weekday").isNotNull() & F.col("hour").isNotNull())
        .groupBy("date", "weekday", "hour")
        .agg(F.count_distinct("order_id").alias("order_count"))
    )
    return cells.groupBy("weekday", "hour").agg(F.avg("order_count").alias("mean_orders"))


def hourly_heatmap(lines: DataFrame) -> DataFrame:
    """``hourly_orders`` with a column per hour, zero where nothing was ordered."""
    names = F.array(*[F.lit(name) for name in WEEKDAY_NAMES])
    hours = list(range(24))
    wide = hourly_orders(lines).groupBy("weekday").pivot("hour", hours).agg(F.first("mean_orders"))
    return wide.select(
        F.get(names, F.col("weekday")).alias("weekday_name"),
        *[F.coalesce(F.col(f"`{hour}`"), F.lit(0.0)).alias(f"h{hour:02d}") for hour in hours],
    )


def ordered_dates(lines: DataFrame) -> DataFrame:
    """Days with orders, oldest first."""
    return lines.where(F.col("date").isNotNull()).select("date").distinct().orderBy("date")


# ---- customers and counts -------------------------------------------------------------------


def customer_profiles(lines: DataFrame) -> DataFrame:
    """Orders, spend, mean line amount, first and last order, favourite category, platforms.

    Ties for the favourite go to the smaller name; platforms stand in the order of first use.
    """
    known = lines.where(F.col("customer_id").isNotNull())
    # The lines are read once; everything else follows from this.
    cells = materialize(
        known.groupBy("customer_id", "category", "platform", "order_id").agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("actual_amount").alias("amount"),
            F.count("actual_amount").alias("amounts"),
            F.min("order_time").alias("first"),
            F.max("order_time").alias("last"),
        ),
        "customer-cells",
    )
    profile = cells.groupBy("customer_id").agg(
        total(F.col("amount")).cast("decimal(28,4)").alias("total_spent"),
        F.try_divide(F.sum("amount").cast("double"), F.sum("amounts").cast("double")).alias("avg_order_value"),
        F.min("first").alias("first_order"),
        F.max("last").alias("last_order"),
    )
    favourite = (
        cells.where(F.col("category").isNotNull())
        .groupBy("customer_id", "category")
        .agg(F.sum("lines").alias("n"))
        .groupBy("customer_id")
        .agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("favorite_category"))
    )
    # As many entries as there are platforms.
    used = (
        cells.where(F.col("platform").isNotNull())
        .groupBy("customer_id", "platform")
        .agg(F.min("first").alias("first"))
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "platform"))).alias("used"))
        .select("customer_id", F.array_join("used.platform", "|").alias("platforms_used"))
    )
    orders = cells.groupBy("customer_id").agg(F.count_distinct("order_id").alias("total_orders"))
    return (
        orders.join(profile, "customer_id")
        .join(favourite, "customer_id", "left")
        .join(used, "customer_id", "left")
        .withColumn("favorite_category", F.coalesce("favorite_category", F.lit("N/A")))
    )


def distinct_counts(lines: DataFrame, columns: list[str], by: str | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values of several columns, exact or from sketches."""
    count = F.approx_count_distinct if approx else F.count_distinct
    grouped = lines.where(F.col(by).isNotNull()).groupBy(by) if by else lines.groupBy()
    return grouped.agg(*[count(c).alias(f"n_{c}") for c in columns])


#: Relative standard error of a count is about 1.04 / sqrt(2^SKETCH_BITS), here 0.8 percent.
SKETCH_BITS = 14


def daily_sketches(lines: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Rows (date, ``by``, one ``s_`` sketch per column): mergeable summaries of a day's distinct values.

    Store them; ``period_counts`` unites those of any days, so a longer period costs its days and not its lines.
    """
    known = with_calendar(lines).where(F.col(by).isNotNull() & F.col("date").isNotNull())
    return known.groupBy("date", by).agg(
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"s_{c}") for c in columns]
    )


def period_counts(sketches: DataFrame, columns: list[str], by: str, period: Column) -> DataFrame:
    """Distinct values per ``by`` and period, estimated from stored sketches; ``period`` is an expression of ``date``."""
    return sketches.groupBy(by, period.alias("period")).agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(f"s_{c}")).alias(f"n_{c}") for c in columns]
    )


def exact_period_counts(lines: DataFrame, columns: list[str], by: str, period: Column) -> DataFrame:
    """The same from the lines, exactly."""
    known = with_calendar(lines).where(F.col(by).isNotNull() & F.col("date").isNotNull())
    return known.groupBy(by, period.alias("period")).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def cross_counts(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Rows counted by two columns, with a column per value of the second."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0).orderBy(rows)
