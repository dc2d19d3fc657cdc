import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlines.functions.expressions import calendar_columns
from orderlines.operators import metrics


def lines_of(spark, rows):
    """Rows: order, line, time, customer, platform, product, category, quantity, amount, status."""
    df = spark.createDataFrame(
        [(o, n, t, c, p, i, k, Decimal(q), Decimal(a), s) for o, n, t, c, p, i, k, q, a, s in rows],
        "order_id string, line_no long, order_time timestamp_ntz, customer_id string, platform string,"
        "product_name string, category string, quantity decimal(18,4), actual_amount decimal(18,4), status string",
    )
    zero = F.lit(0).cast("decimal(18,4)")
    return df.withColumns(
        {
            "total_amount": F.col("actual_amount"),
            "unit_price": F.col("actual_amount"),
            "discount": zero,
            "refund_amount": zero,
            **calendar_columns(F.col("order_time")),
        }
    )


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def lines(spark):
    return lines_of(
        spark,
        [
            ("1", 0, at(1), "c1", "A", "tea", "drink", 1, 10, None),
            ("1", 1, at(1), "c1", "A", "rice", "food", 2, 20, "refunded"),
            ("1", 2, at(1), "c1", "A", "tea", "drink", 1, 10, "completed"),
            ("2", 3, at(1, 18), "c2", "B", "tea", "drink", 1, 0, "completed"),
            ("3", 4, at(4), "c1", "B", "soup", "food", 5, 60, "completed"),
            ("4", 5, at(8), "c3", "A", "rice", "food", 1, 0, "refunded"),
        ],
    )


def test_rollup_takes_first_non_null_status(lines):
    rows = {r["order_id"]: r for r in metrics.order_rollup(lines).collect()}
    assert rows["1"]["status"] == "refunded" and rows["1"]["actual_amount"] == 40
    assert rows["1"]["item_count"] == 3


def test_overview(lines):
    row = metrics.overview(lines).first()
    assert row["total_revenue"] == 100.0 and row["total_orders"] == 4 and row["n_customers"] == 3
    assert row["refund_rate"] == 50.0  # orders
    assert row["today_revenue"] == 0.0 and row["yesterday_revenue"] == 60.0
    assert row["dod_change"] == round(-60 / 60.01 * 100, 2)
    assert row["date_range"] == "2024-01-01 ~ 2024-01-08"
    assert row["revenue_stats"]["median"] == 40.0


def test_platform_refunds_count_lines(lines):
    rows = {r["platform"]: r for r in metrics.platform_comparison(lines).collect()}
    assert rows["A"]["refund_rate"] == 50.0 and rows["B"]["refund_rate"] == 0.0
    assert rows["A"]["avg_order_value"] == 20.0 and rows["B"]["unique_customers"] == 2


def test_trend_has_gaps_and_no_infinity(lines):
    rows = metrics.daily_trend(lines).orderBy("date").collect()
    assert [r["date"].day for r in rows] == [1, 4, 8]
    assert [r["dod_pct"] for r in rows] == [None, 50.0, -100.0]
    assert [r["ma7"] for r in rows] == [40.0, 50.0, pytest.approx(100 / 3)]


def test_change_on_a_day_without_revenue_is_null(spark):
    lines = lines_of(spark, [("1", 0, at(1), "c", "A", "x", "k", 1, 0, "completed"), ("2", 0, at(2), "c", "A", "x", "k", 1, 5, "completed")])
    assert metrics.daily_trend(lines).orderBy("date").collect()[1]["dod_pct"] is None


def test_ranking_and_slow_movers(lines):
    ranking = metrics.product_ranking(lines)
    assert [r["product_name"] for r in ranking.collect()] == ["soup", "rice", "tea"]
    assert [r["product_name"] for r in metrics.slow_movers(ranking).collect()] == ["tea"]
    tea = ranking.where("product_name = 'tea'").first()
    assert tea["order_count"] == 2 and tea["order_penetration"] == 50.0


def test_slow_movers_take_a_fifth(spark):
    ranking = spark.createDataFrame([(f"p{i:02d}", float(i // 3)) for i in range(23)], "product_name string, total_sold double")
    expected = sorted(ranking.collect(), key=lambda r: (-r["total_sold"], r["product_name"]))[-4:]
    assert set(metrics.slow_movers(ranking).collect()) == set(expected)


def test_heatmap(lines):
    rows = {r["weekday_name"]: r for r in metrics.hourly_heatmap(lines).collect()}
    assert rows["周一"]["h12"] == 1.0 and rows["周一"]["h18"] == 1.0 and rows["周一"]["h00"] == 0.0
    assert set(rows) == {"周一", "周四"}


def test_customer_profile(lines):
    rows = {r["customer_id"]: r for r in metrics.customer_profiles(lines).collect()}
    assert rows["c1"]["platforms_used"] == "A|B" and rows["c1"]["favorite_category"] == "drink"
    assert rows["c1"]["avg_order_value"] == 25.0 and rows["c1"]["total_orders"] == 2


def test_results_do_not_depend_on_partitions(lines):
    for operator in (metrics.order_rollup, metrics.product_ranking, metrics.daily_features, metrics.customer_profiles):
        assert sorted(map(str, operator(lines.repartition(1)).collect())) == sorted(
            map(str, operator(lines.repartition(9)).collect())
        )


# ---- layout by order, hot orders, periods -----------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_lines_need_no_shuffle_by_order(spark):
    import uuid

    from orderlines.operators import outliers, quality
    from orderlines.sources.star import star_lines
    from orderlines.sources.writers import write_bucketed

    lines = star_lines(spark, "/root/testdata/sf0.001")
    table = write_bucketed(lines, f"lines_{uuid.uuid4().hex}", buckets=4)
    rollup, features = metrics.order_rollup(table, merge_first=True), outliers.order_features(table)
    assert "Exchange" not in plan_of(rollup) and "Exchange" not in plan_of(features)
    totals = table.where("order_id IS NOT NULL").groupBy("order_id").sum("actual_amount")
    assert "Exchange" not in plan_of(totals)
    key = lambda r: r["order_id"]
    assert sorted(rollup.collect(), key=key) == sorted(metrics.order_rollup(lines).collect(), key=key)
    assert sorted(features.collect(), key=key) == sorted(outliers.order_features(lines).collect(), key=key)
    plain, laid = quality.screen_orders(lines), quality.screen_orders(table)
    assert (plain.lower, plain.upper) == (laid.lower, laid.upper)


def test_hot_order_merges_before_the_shuffle(spark):
    """An order with half of all lines sends one row per task."""
    lines = spark.range(0, 4000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id").cast("string"))).alias("order_id"),
        (4000 - F.col("id")).alias("line_no"),
        F.timestamp_seconds(F.col("id") * 60).alias("order_time"),
        *[F.when(F.col("id") != 3998, F.concat(F.lit(c), F.col("id").cast("string"))).alias(c) for c in ("customer_id", "platform", "status", "product_name")],
        *[F.lit(1).cast("decimal(18,4)").alias(c) for c in ("total_amount", "actual_amount", "discount", "refund_amount")],
    )
    rollup = metrics.order_rollup(lines, merge_first=True)
    # In the printed plan the root is first: final aggregate, exchange, partial aggregate.
    plan = plan_of(rollup)
    assert plan.index("Exchange hashpartitioning(order_id") < plan.index("partial_sum(") and "RepartitionByExpression" not in plan
    hot = rollup.where("order_id = 'hot'").first()
    assert hot["actual_amount"] == 2000 and hot["item_count"] == 1999 and hot["customer_id"] == "customer_id3996"
    assert rollup.count() == 2001


def test_period_counts_from_sketches(spark):
    rows = [(dt.date(2024, 1 + i % 4, 1 + i % 28), f"c{i % 2}", f"v{i * i % 907}", None) for i in range(6000)]
    rows += [(None, "c0", "lost", None), (dt.date(2024, 1, 1), None, "lost", None)]
    lines = spark.createDataFrame(rows, "date date, category string, value string, nothing string")
    sketches = metrics.daily_sketches(lines, ["value", "nothing"], "category")
    month = F.month("date")
    about = {(r["category"], r["period"]): r for r in metrics.period_counts(sketches, ["value", "nothing"], "category", month).collect()}
    exact = metrics.exact_period_counts(lines, ["value", "nothing"], "category", month).collect()
    assert len(exact) == len(about) > 3
    for r in exact:
        found = about[r["category"], r["period"]]
        assert abs(found["n_value"] - r["n_value"]) <= 0.03 * r["n_value"] + 1 and found["n_nothing"] == r["n_nothing"] == 0
