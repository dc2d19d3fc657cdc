"""The registered queries: one per operator, over the star-schema and event tables.

Every query takes ``(spark, sf_dir)``. Dates leave as ``yyyy-MM-dd`` text and money as double; trailing
means and other floating sums are rounded, because their last digit depends on the order of summing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlines.functions.expressions import day_text
from orderlines.functions.order_statistics import Ordering
from orderlines.functions.storage import marked, materialize, new_path, settle, shared_folder, shuffles_dropped
from orderlines.operators import (
    agreement,
    basket,
    cleaning,
    clustering,
    diagnosis,
    forecasting,
    metrics,
    outliers,
    quality,
    rfm,
)
from orderlines.plans.preparation import clean
from orderlines.plans.report import diagnose
from orderlines.schema import ORDER_LINE
from orderlines.sources.readers import read_orders, read_typed_orders
from orderlines.sources.star import event_lines, raw_export, star_lines
from orderlines.sources.writers import write_bucketed, write_csv, write_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Supports that the tables reach: products are bought almost independently of each other, so a
# pair is found in about 0.4 percent of the orders and a triple in 0.025 percent.
PAIR_SUPPORT = 0.002
TRIPLE_SUPPORT = 0.0005


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def flat(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Plain output types; ``digits`` rounds the named columns."""
    digits = digits or {}
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            column = day_text(column)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        if field.name in digits:
            column = F.round(column.cast("double"), digits[field.name])
        columns.append(column.alias(field.name))
    return df.select(*columns)


def summed(df: DataFrame, by: str) -> DataFrame:
    """Rows and exact sums of the money columns per value of ``by``."""
    money = [c for c in ("quantity", "unit_price", "total_amount", "discount", "actual_amount", "refund_amount") if c in df.columns]
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(c) for c in money],
    )


# ---- sources and sinks ----------------------------------------------------------------------


def _export(spark: SparkSession, lines: DataFrame, name: str, charset: str = "UTF-8") -> str:
    """Write lines as a platform's CSV export and return its path."""
    path = new_path(spark, name)
    if charset != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    lines.write.option("header", True).option("encoding", charset).csv(path)
    return path


@query
def s1_csv_scan(spark, sf_dir):
    lines = star_lines(spark, sf_dir).select(
        F.col("order_id").alias("订单编号"),
        F.col("product_name").alias("商品名称"),
        F.concat(F.lit("品类"), "category").alias("分类"),
        F.col("quantity").alias("数量"),
        F.col("total_amount").alias("总金额"),
    )
    path = _export(spark, lines, "gbk", "GBK")
    return summed(read_orders(spark, path), "category")


@query
def s2_typed_csv_scan(spark, sf_dir):
    path = new_path(spark, "typed")
    lines = star_lines(spark, sf_dir)
    write_csv(lines.select(*ORDER_LINE.fieldNames()), path)
    return summed(read_typed_orders(spark, path).withColumn("day", day_text("date")), "day")


@query
def s3_format_dispatch(spark, sf_dir):
    path = new_path(spark, "by-date")
    write_parquet(event_lines(spark, sf_dir), path)
    return summed(read_orders(spark, path, format="parquet"), "platform")


@query
def s4_csv_sink(spark, sf_dir):
    path = new_path(spark, "profiles")
    write_csv(metrics.customer_profiles(star_lines(spark, sf_dir)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        "customer_id",
        F.col("total_orders").cast("long").alias("total_orders"),
        F.col("total_spent").cast("double").alias("total_spent"),
        F.substring("last_order", 1, 10).alias("last_order"),
        "favorite_category",
        "platforms_used",
    )


@query
def s5_export_union(spark, sf_dir):
    lines = star_lines(spark, sf_dir)
    urgent = F.col("platform").isin("1-URGENT", "2-HIGH")
    medium = F.col("platform") == "3-MEDIUM"
    first = lines.where(urgent).select(
        F.col("order_id").alias("订单编号"),
        F.col("product_name").alias("菜品名称"),
        F.col("total_amount").alias("原价"),
        F.col("platform").alias("来源"),
    )
    second = lines.where(medium).select(
        F.col("platform").alias("platform_name"),
        F.col("total_amount").alias("amount"),
        F.col("product_name").alias("productName"),
        F.col("order_id").alias("orderId"),
    )
    third = lines.where(~urgent & ~medium).select(
        "order_id", "product_name", "total_amount", "platform", "discount"
    )
    paths = [
        _export(spark, first, "first", "GBK"),
        _export(spark, second, "second"),
        _export(spark, third, "third"),
    ]
    return summed(read_orders(spark, paths), "platform")


# ---- normalization and cleaning -------------------------------------------------------------


def _coerced(spark: SparkSession, sf_dir: str, platform: bool = True) -> DataFrame:
    return cleaning.coerce(cleaning.normalize_columns(raw_export(spark, sf_dir, platform)))


def _filled(spark: SparkSession, sf_dir: str, *without: str) -> DataFrame:
    coerced = _coerced(spark, sf_dir).drop(*without)
    return cleaning.fill(cleaning.deduplicate(coerced))


@query
def p1_alias_rename(spark, sf_dir):
    return summed(cleaning.normalize_columns(raw_export(spark, sf_dir)), "category")


@query
def p2_required_fields(spark, sf_dir):
    raw = raw_export(spark, sf_dir).drop("菜品名称", "amount")
    missing = cleaning.missing_required(cleaning.normalize_columns(raw).columns)
    return raw.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.array(*[F.lit(name) for name in missing])).alias("missing"), "rows"
    )


@query
def p3_time_parts(spark, sf_dir):
    times = _coerced(spark, sf_dir).select("order_id", "order_time", cleaning.BAD_TIME)
    parts = times.withColumns(cleaning.calendar_columns(F.col("order_time")))
    return flat(
        parts.groupBy("date", "hour", "weekday", "is_weekend").agg(
            F.count(F.lit(1)).alias("n"), F.sum(cleaning.BAD_TIME).alias("bad_times")
        )
    )


@query
def p4_numeric_clamp(spark, sf_dir):
    lines = _coerced(spark, sf_dir)
    negative = cleaning.NEGATIVE + "unit_price"
    return lines.groupBy("product_name").agg(
        F.sum(negative).alias("negative_prices"),
        F.min("unit_price").cast("double").alias("least_price"),
        F.sum("unit_price").cast("double").alias("prices"),
        F.count("quantity").alias("quantities"),
    )


@query
def p5_default_platform(spark, sf_dir):
    return summed(_coerced(spark, sf_dir, platform=False), "platform")


@query
def p6_dedup(spark, sf_dir):
    distinct = cleaning.deduplicate(_coerced(spark, sf_dir))
    return distinct.groupBy("category").agg(
        F.count(F.lit(1)).alias("clean_rows"), F.sum(cleaning.COPIES).alias("raw_rows")
    )


@query
def p7_null_fill(spark, sf_dir):
    return summed(_filled(spark, sf_dir), "category")


@query
def p8_derived_fill(spark, sf_dir):
    lines = _filled(spark, sf_dir)
    return flat(
        lines.select("order_id", "product_name", "total_amount", "quantity", "unit_price", "actual_amount"),
        {"unit_price": 4},
    )


@query
def p9_derived_amount(spark, sf_dir):
    return summed(_filled(spark, sf_dir, "actual_amount", "_negative_actual_amount"), "platform")


@query
def p10_default_status(spark, sf_dir):
    lines = _filled(spark, sf_dir, "status", "customer_id")
    return lines.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("customer_id") == F.col("order_id")).alias("by_order"),
        F.count_distinct("customer_id").alias("customers"),
    )


@query
def p11_clean_lines(spark, sf_dir):
    lines = clean(raw_export(spark, sf_dir)).lines
    return flat(
        lines.select(
            "order_id", "order_time", "date", "hour", "weekday", "is_weekend", "customer_id",
            "platform", "product_name", "category", "quantity", "unit_price", "total_amount",
            "discount", "actual_amount", "refund_amount", "status", "is_anomaly",
        ),
        {"unit_price": 4},
    )


@query
def p12_predicates(spark, sf_dir):
    lines = star_lines(spark, sf_dir, products=False).where(
        (F.col("status") == "refunded")
        & (F.col("actual_amount") < 50000)
        & F.col("platform").isin("1-URGENT", "2-HIGH")
        & F.col("order_time").isNotNull()
    )
    return summed(lines, "platform")


# ---- quality --------------------------------------------------------------------------------


@query
def q1_order_outliers(spark, sf_dir):
    screen = quality.screen_orders(star_lines(spark, sf_dir, products=False))
    return flat(
        screen.outliers().select(
            "order_id",
            "amount",
            F.round(F.lit(screen.lower), 2).alias("lower_bound"),
            F.round(F.lit(screen.upper), 2).alias("upper_bound"),
        )
    )


@query
def q1_bucketed_outliers(spark, sf_dir):
    screen = quality.screen_orders(_by_order(spark, sf_dir))
    bounds = {"lower_bound": screen.lower, "upper_bound": screen.upper}
    return flat(screen.outliers().select("order_id", "amount", *[F.round(F.lit(v), 2).alias(k) for k, v in bounds.items()]))


@query
def q2_quantity_outliers(spark, sf_dir):
    values = event_lines(spark, sf_dir).select(F.col("total_amount").alias("quantity"))
    return quality.quantity_outliers(materialize(values, "quantities"))


@query
def q3_quality_report(spark, sf_dir):
    return clean(raw_export(spark, sf_dir, platform=False)).quality


@query
def q4_profile(spark, sf_dir):
    lines = materialize(star_lines(spark, sf_dir), "lines")
    return flat(quality.profile(lines), {"mean": 4, "std": 4, "q25": 4, "q50": 4, "q75": 4})


@query
def j2_flagged_lines(spark, sf_dir):
    lines = materialize(star_lines(spark, sf_dir, products=False).select("order_id", "platform", "actual_amount"), "lines")
    flagged = quality.flag_outlier_orders(lines, quality.screen_orders(lines))
    return flagged.groupBy("is_anomaly", "platform").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual_amount").cast("double").alias("amount")
    )


# ---- metrics --------------------------------------------------------------------------------


@query
def a1_order_rollup(spark, sf_dir):
    return flat(metrics.order_rollup(star_lines(spark, sf_dir), merge_first=True))


def _by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a table bucketed by order."""
    return write_bucketed(star_lines(spark, sf_dir), f"lines_{uuid.uuid4().hex}", buckets=16)


@query
def a1_bucketed_rollup(spark, sf_dir):
    return flat(metrics.order_rollup(_by_order(spark, sf_dir), merge_first=True))


@query
def a2_overview(spark, sf_dir):
    return metrics.overview(star_lines(spark, sf_dir)).select(
        "total_revenue", "total_orders", "avg_order_value", "refund_rate", "avg_discount_rate",
        "date_range", "n_customers",
    )


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = metrics.order_rollup(star_lines(spark, sf_dir), merge_first=True)
    return metrics.daily_orders(metrics.customer_days(rollup))


@query
def a3_latest_day(spark, sf_dir):
    return metrics.latest_days(_daily(spark, sf_dir))


@query
def a4_revenue_distribution(spark, sf_dir):
    return metrics.revenue_distribution(_daily(spark, sf_dir))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.product_ranking(star_lines(spark, sf_dir))


@query
def a5_product_ranking(spark, sf_dir):
    return flat(_ranking(spark, sf_dir))


@query
def a6_category_breakdown(spark, sf_dir):
    return metrics.category_breakdown(star_lines(spark, sf_dir))


@query
def a7_slow_movers(spark, sf_dir):
    ranking = materialize(_ranking(spark, sf_dir), "ranking")
    return metrics.slow_movers(ranking).select("product_name", "total_sold", "order_count")


@query
def a8_platform_comparison(spark, sf_dir):
    return metrics.platform_comparison(star_lines(spark, sf_dir, products=False))


@query
def a9_daily_trend(spark, sf_dir):
    return flat(metrics.daily_trend(star_lines(spark, sf_dir, products=False)), {"ma7": 6})


@query
def a10_daily_features(spark, sf_dir):
    digits = {"revenue_ma7": 6, "orders_ma7": 6}
    return flat(metrics.daily_features(star_lines(spark, sf_dir, products=False)), digits)


@query
def a11_category_features(spark, sf_dir):
    return metrics.category_features(star_lines(spark, sf_dir))


@query
def a12_hourly_heatmap(spark, sf_dir):
    hours = {f"h{hour:02d}": 4 for hour in range(24)}
    return flat(metrics.hourly_heatmap(event_lines(spark, sf_dir)), hours)


@query
def a13_customer_profiles(spark, sf_dir):
    return flat(metrics.customer_profiles(star_lines(spark, sf_dir)))


@query
def a14_distinct_counts(spark, sf_dir):
    lines = star_lines(spark, sf_dir)
    return metrics.distinct_counts(lines, ["order_id", "customer_id", "product_name"], by="category")


@query
def a14_period_counts(spark, sf_dir):
    """Exact counts per quarter, and whether those from daily sketches are within three percent."""
    lines = materialize(star_lines(spark, sf_dir), "lines")
    columns = ["order_id", "customer_id"]
    quarter = F.concat_ws("-Q", F.year("date").cast("string"), F.quarter("date").cast("string"))
    stored = materialize(metrics.daily_sketches(lines, columns, "category"), "sketches")
    about = metrics.period_counts(stored, columns, "category", quarter).withColumnsRenamed({f"n_{c}": f"about_{c}" for c in columns})
    exact = metrics.exact_period_counts(lines, columns, "category", quarter)
    close = [F.abs(F.col(f"about_{c}") - F.col(f"n_{c}")) <= 0.03 * F.col(f"n_{c}") + 1 for c in columns]
    return exact.join(about, ["category", "period"], "left").select(
        "category", "period", *[f"n_{c}" for c in columns], F.coalesce(close[0] & close[1], F.lit(False)).alias("sketches_close")
    )


@query
def a15_value_counts(spark, sf_dir):
    return metrics.value_counts(star_lines(spark, sf_dir), "product_name")


@query
def w1_previous_day(spark, sf_dir):
    trend = metrics.daily_trend(event_lines(spark, sf_dir), ["platform"])
    return flat(trend.select("platform", "date", "revenue", "prev_revenue", "dod_pct"))


@query
def w2_trailing_mean(spark, sf_dir):
    trend = metrics.daily_trend(event_lines(spark, sf_dir), ["platform"])
    return flat(trend.select("platform", "date", "ma7"), {"ma7": 6})


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = metrics.daily_trend(event_lines(spark, sf_dir), ["platform"])
    return forecasting.lag_features(forecasting.revenue_series(trend, "platform"))


@query
def w3_lags(spark, sf_dir):
    return flat(_features(spark, sf_dir).select("series", "date", "lag_1", "lag_2", "lag_3", "lag_7"))


@query
def w4_rolling_stats(spark, sf_dir):
    return flat(
        _features(spark, sf_dir).select("series", "date", "rolling_mean_7", "rolling_std_7"),
        {"rolling_mean_7": 6, "rolling_std_7": 6},
    )


@query
def w5_row_ordinal(spark, sf_dir):
    return flat(_features(spark, sf_dir).select("series", "date", "day_num"))


@query
def w6_rank(spark, sf_dir):
    values = rfm.rfm_values(star_lines(spark, sf_dir, products=False))
    return Ordering(values, ["frequency", "customer_id"]).ranked()


@query
def w7_tercile_bins(spark, sf_dir):
    values = rfm.rfm_values(star_lines(spark, sf_dir, products=False))
    return (
        rfm.rfm_scores(values)
        .groupBy("R_score", "F_score", "M_score")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


@query
def k2_top_products(spark, sf_dir):
    return metrics.best_sellers(_ranking(spark, sf_dir), 15).select("product_name", "total_sold")


@query
def k4_ordered_dates(spark, sf_dir):
    return flat(metrics.ordered_dates(star_lines(spark, sf_dir, products=False)))


@query
def k5_orders_by_hour(spark, sf_dir):
    return flat(metrics.hourly_orders(event_lines(spark, sf_dir)), {"mean_orders": 6})


# ---- customers ------------------------------------------------------------------------------


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.rfm_segments(star_lines(spark, sf_dir, products=False))


@query
def f1_rfm_values(spark, sf_dir):
    return flat(rfm.rfm_values(star_lines(spark, sf_dir, products=False)))


@query
def f2_tercile_scores(spark, sf_dir):
    return _segments(spark, sf_dir).select("customer_id", "R_score", "F_score", "M_score")


@query
def f3_segments(spark, sf_dir):
    return flat(_segments(spark, sf_dir).drop("strategy"))


@query
def f4_strategies(spark, sf_dir):
    return _segments(spark, sf_dir).select("customer_id", "segment", "strategy")


@query
def f5_segment_distribution(spark, sf_dir):
    return rfm.segment_distribution(_segments(spark, sf_dir))


@query
def f6_at_risk(spark, sf_dir):
    return flat(rfm.at_risk_customers(_segments(spark, sf_dir)).select("customer_id", "segment", "monetary"))


@query
def c1_standardized(spark, sf_dir):
    scaled = clustering.standardize(_segments(spark, sf_dir))
    names = ["z_recency", "z_frequency", "z_monetary"]
    return flat(scaled.select("customer_id", *names), {name: 6 for name in names})


@query
def c2_clusters(spark, sf_dir):
    return clustering.cluster_customers(_segments(spark, sf_dir)).customers.select("customer_id", "cluster")


@query
def c3_cluster_profiles(spark, sf_dir):
    found = clustering.cluster_customers(_segments(spark, sf_dir))
    return found.centers.withColumn("inertia", F.lit(found.inertia))


@query
def c4_elbow(spark, sf_dir):
    return clustering.elbow(materialize(_segments(spark, sf_dir), "segments"))


@query
def k6_segments_by_cluster(spark, sf_dir):
    segments = materialize(_segments(spark, sf_dir), "segments")
    clusters = clustering.cluster_customers(segments).customers.select("customer_id", "cluster")
    return metrics.cross_counts(
        segments.join(clusters, "customer_id"), "segment", "cluster", [0, 1, 2, 3]
    )


@query
def c5_segment_agreement(spark, sf_dir):
    segments = materialize(_segments(spark, sf_dir), "segments")
    clusters = clustering.cluster_customers(segments).customers.select("customer_id", "cluster")
    return flat(agreement.agreement(segments.join(clusters, "customer_id"), "segment", "cluster"), {"value": 6})


# ---- baskets --------------------------------------------------------------------------------


def _itemsets(spark: SparkSession, sf_dir: str, support: float) -> DataFrame:
    return basket.frequent_itemsets(star_lines(spark, sf_dir), support)


@query
def m1_baskets(spark, sf_dir):
    return basket.bought_items(basket.order_items(star_lines(spark, sf_dir)))


@query
def m2_itemsets(spark, sf_dir):
    found = _itemsets(spark, sf_dir, TRIPLE_SUPPORT)
    return found.select(F.array_join("items", ",").alias("items"), "freq", "orders")


@query
def m3_rules(spark, sf_dir):
    rules = basket.association_rules(_itemsets(spark, sf_dir, TRIPLE_SUPPORT), 1.0)
    return flat(
        rules.withColumns({side: F.array_join(side, ",") for side in ("antecedent", "consequent")}),
        {"support": 6, "confidence": 6, "lift": 6},
    )


@query
def m4_top_rules(spark, sf_dir):
    return basket.top_rules(basket.association_rules(_itemsets(spark, sf_dir, TRIPLE_SUPPORT)))


@query
def m5_pair_rules(spark, sf_dir):
    rules = basket.pair_rules(star_lines(spark, sf_dir), PAIR_SUPPORT)
    return flat(rules, {"support": 6, "confidence": 6, "lift": 6})


# ---- forecasts ------------------------------------------------------------------------------


@query
def t1_lag_features(spark, sf_dir):
    return flat(_features(spark, sf_dir), {"rolling_mean_7": 6, "rolling_std_7": 6})


def _forecast(spark: SparkSession, sf_dir: str) -> forecasting.Forecast:
    trend = metrics.daily_trend(event_lines(spark, sf_dir), ["platform"])
    return forecasting.forecast(forecasting.revenue_series(trend, "platform"))


@query
def t2_forest_fit(spark, sf_dir):
    return _forecast(spark, sf_dir).quality


@query
def t3_forecast(spark, sf_dir):
    return flat(_forecast(spark, sf_dir).days)


def _weekly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per event type and calendar week: all are too short for the forest."""
    week = F.concat_ws("/", "platform", F.weekofyear("date").cast("string"))
    lines = event_lines(spark, sf_dir).withColumn("series", week)
    return forecasting.revenue_series(metrics.daily_trend(lines, ["series"]), "series")


@query
def t4_short_history(spark, sf_dir):
    return flat(forecasting.forecast(_weekly_series(spark, sf_dir)).days)


@query
def t5_forecast_summary(spark, sf_dir):
    found = forecasting.forecast_summary(_forecast(spark, sf_dir).days)
    return flat(found, {c: 2 for c in ("total", "mean", "mean_lower", "mean_upper")})


@query
def t5_short_summary(spark, sf_dir):
    found = forecasting.forecast_summary(forecasting.mean_forecast(_weekly_series(spark, sf_dir)))
    return flat(found, {c: 2 for c in ("total", "mean", "mean_lower", "mean_upper")})


# ---- unusual orders -------------------------------------------------------------------------


@query
def d1_order_features(spark, sf_dir):
    return flat(outliers.order_features(star_lines(spark, sf_dir)))


@query
def d1_bucketed_features(spark, sf_dir):
    return flat(outliers.order_features(_by_order(spark, sf_dir)))


@query
def d2_isolation_forest(spark, sf_dir):
    scored = outliers.isolation_forest(star_lines(spark, sf_dir))
    return scored.select("order_id", "anomaly_score", "anomaly_label", "is_anomaly")


@query
def d3_verdicts(spark, sf_dir):
    lines = materialize(star_lines(spark, sf_dir), "lines")
    return outliers.verdicts(quality.screen_orders(lines), outliers.isolation_forest(lines))


# ---- diagnosis ------------------------------------------------------------------------------


@query
def r1_kpi_verdicts(spark, sf_dir):
    return diagnosis.kpi_verdicts(metrics.overview(star_lines(spark, sf_dir)))


@query
def r2_alerts(spark, sf_dir):
    lines = materialize(star_lines(spark, sf_dir), "lines")
    orders = quality.screen_orders(lines).outliers().withColumn("is_anomaly", F.lit(True))
    return diagnosis.alerts(metrics.overview(lines), orders)


@query
def r3_product_findings(spark, sf_dir):
    return diagnosis.product_findings(materialize(_ranking(spark, sf_dir), "ranking"))


def _pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules_of(star_lines(spark, sf_dir))


def _rules_of(lines: DataFrame) -> DataFrame:
    itemsets = basket.frequent_itemsets(lines, PAIR_SUPPORT)
    return materialize(basket.top_rules(basket.association_rules(itemsets)), "rules")


@query
def r4_rule_findings(spark, sf_dir):
    return diagnosis.rule_findings(_pair_rules(spark, sf_dir))


@query
def r5_actions(spark, sf_dir):
    unread = ("date", "hour", "weekday", "is_weekend", "platform", "total_amount", "discount", "refund_amount")
    lines = materialize(star_lines(spark, sf_dir).drop(*unread), "lines")
    return diagnosis.actions(
        materialize(metrics.product_ranking(lines), "ranking"),
        _rules_of(lines),
        materialize(rfm.rfm_segments(lines), "segments"),
    )


#: Lines of a bucket of the diagnosis: a task of some hundred MB.
BUCKET_LINES = 500_000


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str | None]:
    """Written lines and the name of their table if they lie there by order, as most analyses of the diagnosis group them.

    An order that alone fills a bucket would be one task of each of these; the lines are then written as they come.
    Calendar fields are left out: they follow from ``order_time`` wherever they are read.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_orderkey").isNotNull())
    # Empty where no order stands out.
    n, largest = items.agg(F.count(F.lit(1)), F.expr("get(approx_top_k(l_orderkey, 1), 0).count")).first()
    unread = ("date", "hour", "weekday", "is_weekend")
    if (largest or 0) > BUCKET_LINES:
        return materialize(star_lines(spark, sf_dir).drop(*unread), "lines"), None
    buckets = max(spark.sparkContext.defaultParallelism, ceil(n / BUCKET_LINES))
    # Spark joins in the session's number of partitions at least; a multiple of the buckets then gives a file per task.
    dealt = buckets * ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / buckets)
    lines, table = star_lines(spark, sf_dir, dealt=dealt).drop(*unread), f"lines_{uuid.uuid4().hex}"
    return write_bucketed(lines, table, buckets, dealt=True, compression="zstd"), table


def _diagnose(spark: SparkSession, sf_dir: str, sections: Collection[str] = diagnosis.SECTIONS) -> DataFrame:
    """The sections over lines that are written once; these and the shuffles go as soon as their results stand."""
    mark = marked(spark)
    with shuffles_dropped(spark):
        lines, table = _laid_out(spark, sf_dir)
        found = diagnose(lines, min_support=PAIR_SUPPORT, sections=sections, by_order=table is not None)
        if shared_folder(spark) is None:
            # A lost part of the result is computed again, from these lines.
            return found
        found = settle(found, "diagnosis", mark)
    if table:
        spark.sql(f"DROP TABLE {table}")
    return found


@query
def r6_diagnosis(spark, sf_dir):
    return _diagnose(spark, sf_dir)


@query
def r6_all_but_forecast(spark, sf_dir):
    """The diagnosis without the section that comes from the fitted forecast."""
    return _diagnose(spark, sf_dir, [section for section in diagnosis.SECTIONS if section != "forecast"])


# ---- facts that any valid fit meets, for the queries whose rows depend on the fit -----------


@query
def k6_facts(spark, sf_dir):
    table = k6_segments_by_cluster(spark, sf_dir)
    return table.select("segment", sum((F.col(f"`{k}`") for k in range(4)), F.lit(0).cast("long")).alias("customers"))


@query
def c2_facts(spark, sf_dir):
    return c2_clusters(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.count_distinct("cluster").alias("clusters"),
    )


@query
def c3_facts(spark, sf_dir):
    """The centres, weighted by their customers, are the means over all customers."""
    customers = clustering.cluster_customers(_segments(spark, sf_dir)).customers
    names = clustering.FEATURES
    centers = customers.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in names]
    )
    return centers.agg(
        F.sum("n").alias("customers"), *[F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 4).alias(c) for c in names]
    )


@query
def c4_facts(spark, sf_dir):
    """One cluster costs one per customer and feature; more clusters cost less."""
    costs = c4_elbow(spark, sf_dir)
    return costs.agg(
        F.max(F.when(F.col("k") == 1, F.col("inertia"))).alias("one_cluster"),
        F.count(F.lit(1)).alias("fits"),
        F.array_sort(F.collect_list(F.struct("k", "inertia"))).alias("all"),
    ).select(
        "one_cluster",
        "fits",
        F.forall(F.sequence(F.lit(1), F.size("all") - 1), lambda i: F.get("all.inertia", i) < F.get("all.inertia", i - 1)).alias("falling"),
    )


@query
def t2_facts(spark, sf_dir):
    return t2_forest_fit(spark, sf_dir).select(
        "series", "forecast_days", "n_features", (F.col("mape").isNotNull() & (F.col("residual_std") >= 0)).alias("has_error")
    )


@query
def t3_facts(spark, sf_dir):
    """Days ahead, order of the bounds, and predictions within what the series has seen."""
    trend = materialize(metrics.daily_trend(event_lines(spark, sf_dir), ["platform"]), "trend")
    series = forecasting.revenue_series(trend, "platform")
    means = series.groupBy("series").agg(F.avg("revenue").alias("mean"))
    share = F.col("revenue") / F.col("mean")
    least, most = series.join(means, "series").agg(F.min(share), F.max(share)).first()
    days = forecasting.forecast(series).days.join(means, "series")
    predicted = F.col("predicted")
    return days.groupBy("series").agg(
        day_text(F.min("date")).alias("first_day"),
        day_text(F.max("date")).alias("last_day"),
        F.count(F.lit(1)).alias("days"),
        F.bool_and((F.col("lower_bound") <= predicted) & (predicted <= F.col("upper_bound"))).alias("in_order"),
        # The forest learns from all series, each as a share of its mean.
        F.bool_and(
            predicted.between(F.col("mean") * least - 0.01, F.col("mean") * most + 0.01)
        ).alias("in_range"),
    )


@query
def t5_facts(spark, sf_dir):
    found = forecasting.forecast_summary(_forecast(spark, sf_dir).days)
    return found.select(
        "series",
        (F.abs(F.col("total") - 7 * F.col("mean")) < 0.01).alias("total_is_seven_means"),
        F.col("trend").isin("上升 ↗", "下降 ↘", "平稳 →").alias("known_trend"),
    )


@query
def d2_facts(spark, sf_dir):
    scored = d2_isolation_forest(spark, sf_dir)
    score = F.col("anomaly_score")
    return scored.agg(
        F.count_distinct("order_id").alias("orders"),
        F.bool_and((score >= -1) & (score < 0)).alias("scores_in_range"),
        (F.count_if("is_anomaly") <= F.ceil(0.05 * F.count(F.lit(1)))).alias("at_most_the_share"),
        F.bool_and((F.col("anomaly_label") == -1) == F.col("is_anomaly")).alias("labels_agree"),
    )


@query
def d3_facts(spark, sf_dir):
    return d3_verdicts(spark, sf_dir).select("order_id", "by_amount")


@query
def r6_facts(spark, sf_dir):
    """The sections of the diagnosis that no fit enters."""
    return _diagnose(spark, sf_dir, ["summary", "volatility", "best sellers", "slow movers"])
