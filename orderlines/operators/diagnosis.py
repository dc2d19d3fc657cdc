"""The written diagnosis as rows ``(section, item, metric, value, label)``.

The inputs are results of the other operators, which are small; each is expected to be written
already, since several sections read it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlines.operators.basket import strength
from orderlines.operators.forecasting import forecast_summary
from orderlines.operators.metrics import best_sellers, slow_movers
from orderlines.operators.rfm import at_risk_customers, segment_distribution


def _finding(section: str, item, metric: str, value, label=None) -> Column:
    def column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(section).alias("section"),
        column(item).cast("string").alias("item"),
        F.lit(metric).alias("metric"),
        column(value).cast("double").alias("value"),
        column(label).cast("string").alias("label"),
    )


def _rows(df: DataFrame, *findings: Column) -> DataFrame:
    return df.select(F.inline(F.array(*findings)))


def period(overview: DataFrame, section: str = "header") -> DataFrame:
    return _rows(overview, _finding(section, None, "period", None, F.col("date_range")))


def kpi_verdicts(overview: DataFrame) -> DataFrame:
    """Headline numbers, with verdicts on refunds, the last day, and the shape of daily revenue."""
    stats = F.col("revenue_stats")
    skew, peak = stats["skewness"], stats["kurtosis"]
    shape = F.when(skew > 0.5, "right").when(F.abs(skew) <= 0.5, "even").otherwise("left")
    return _rows(
        overview,
        _finding("summary", None, "total_revenue", F.col("total_revenue")),
        _finding("summary", None, "total_orders", F.col("total_orders")),
        _finding("summary", None, "avg_order_value", F.col("avg_order_value")),
        _finding(
            "summary", None, "refund_rate", F.col("refund_rate"),
            F.when(F.col("refund_rate") > 5, "high").otherwise("normal"),
        ),
        _finding("summary", None, "avg_discount_rate", F.col("avg_discount_rate")),
        _finding("summary", None, "today_revenue", F.col("today_revenue")),
        _finding("summary", None, "today_orders", F.col("today_orders")),
        _finding(
            "summary", None, "dod_change", F.abs("dod_change"),
            F.when(F.col("dod_change") >= 0, "↑").otherwise("↓"),
        ),
        _finding("summary", None, "daily_mean", stats["mean"]),
        _finding("summary", None, "daily_median", stats["median"]),
        _finding("volatility", None, "std", stats["std"]),
        _finding("volatility", None, "skewness", skew, shape),
        _finding("volatility", None, "kurtosis", peak, F.when(peak > 0, "peaked").otherwise("flat")),
    )


def alerts(overview: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows for what needs attention: flagged orders, a jump of the last day, many refunds."""
    flagged = orders.agg(F.count_if("is_anomaly")).scalar()
    change = F.abs("dod_change")
    refund = F.col("refund_rate")
    found = _rows(
        overview.withColumn("_flagged", flagged),
        _finding("alerts", F.when(F.col("_flagged") > 0, "orders"), "anomalous_orders", F.col("_flagged")),
        _finding("alerts", F.when(change > 30, "revenue"), "dod_change", change),
        _finding("alerts", F.when(refund > 5, "refunds"), "refund_rate", refund),
    )
    return found.where(F.col("item").isNotNull())


def product_findings(ranking: DataFrame) -> DataFrame:
    """The five best sellers with revenue and share, and the slow movers."""
    best = _rows(
        best_sellers(ranking),
        _finding("best sellers", F.col("product_name"), "total_sold", F.col("total_sold")),
        _finding("best sellers", F.col("product_name"), "total_revenue", F.col("total_revenue")),
        _finding("best sellers", F.col("product_name"), "revenue_share", F.col("revenue_share")),
    )
    slow = _rows(
        slow_movers(ranking),
        _finding("slow movers", F.col("product_name"), "total_sold", F.col("total_sold")),
    )
    return best.unionByName(slow)


def _best_rules(rules: DataFrame, n: int) -> DataFrame:
    return rules.orderBy(
        F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent", "consequent"
    ).limit(n)


def rule_findings(rules: DataFrame, n: int = 3) -> DataFrame:
    """The best rules with their measures and grade."""
    pair = F.concat_ws(" → ", "antecedent", "consequent")
    return _rows(
        _best_rules(rules, n),
        _finding("rules", pair, "lift", F.col("lift"), strength()),
        _finding("rules", pair, "support", F.col("support")),
        _finding("rules", pair, "confidence", F.col("confidence")),
        _finding("rules", pair, "recommendation", None, F.col("recommendation")),
    )


def segment_findings(segments: DataFrame) -> DataFrame:
    """Size, share and strategy per segment, and the number of valuable customers at risk."""
    sizes = _rows(
        segment_distribution(segments),
        _finding("segments", F.col("segment"), "customers", F.col("customers"), F.col("strategy")),
        _finding("segments", F.col("segment"), "share", F.col("share")),
    )
    return sizes.unionByName(_at_risk(segments, "segments"))


def _at_risk(segments: DataFrame, section: str) -> DataFrame:
    counted = at_risk_customers(segments).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return _rows(counted, _finding(section, None, "at_risk", F.col("n")))


def forecast_findings(predicted: DataFrame) -> DataFrame:
    """Seven-day total, mean and mean bounds, and the direction, per series."""
    series = F.col("series")
    return _rows(
        forecast_summary(predicted),
        _finding("forecast", series, "total", F.round("total", 2), F.col("trend")),
        _finding("forecast", series, "mean", F.round("mean", 2)),
        _finding("forecast", series, "mean_lower", F.round("mean_lower", 2)),
        _finding("forecast", series, "mean_upper", F.round("mean_upper", 2)),
    )


def actions(ranking: DataFrame, rules: DataFrame, segments: DataFrame) -> DataFrame:
    """What to do: bundle the best rule, win back customers at risk, drop the least sold product."""
    bundle = _rows(
        _best_rules(rules, 1),
        _finding("actions", None, "bundle", F.col("lift"), F.col("recommendation")),
    )
    weakest = ranking.orderBy("total_sold", F.desc("product_name")).limit(1)
    weak = _rows(
        weakest, _finding("actions", F.col("product_name"), "weak_product", F.col("total_sold"))
    )
    return _union(bundle, _at_risk(segments, "actions"), weak)


#: The sections of the diagnosis, in order.
SECTIONS = ("header", "summary", "volatility", "alerts", "best sellers", "slow movers", "rules", "segments", "forecast", "actions", "footer")


def diagnosis(
    overview: DataFrame | None,
    ranking: DataFrame | None,
    segments: DataFrame | None,
    rules: DataFrame | None,
    predicted: DataFrame | None,
    orders: DataFrame | None,
) -> DataFrame:
    """All sections, from the header to the footer; those that need a result given as None are left out."""
    parts = [
        (period, overview),
        (kpi_verdicts, overview),
        (alerts, overview, orders),
        (product_findings, ranking),
        (rule_findings, rules),
        (segment_findings, segments),
        (forecast_findings, predicted),
        (actions, ranking, rules, segments),
        (lambda found: period(found, "footer"), overview),
    ]
    return _union(*[part(*given) for part, *given in parts if all(frame is not None for frame in given)])


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
