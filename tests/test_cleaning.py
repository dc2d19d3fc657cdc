from decimal import Decimal

import pytest

from orderlines import clean
from orderlines.operators.cleaning import missing_required

DIRTY = [
    # order, time, product, category, qty, price, total, discount, actual
    ("1", "2024-01-05 10:00", "a", "x", "2", "5", "10", "1", "9"),
    ("1", "2024-01-05 10:00", "a", "x", "2", "5", "10", "1", "9"),
    ("2", "not a date", "b", None, None, None, "8", None, None),
    ("3", None, "c", "y", "0", None, "7", "0", "7"),
    ("4", "2024/1/6", "d", "y", "abc", "-3", "-1", "0", "4"),
]
NAMES = ["order_id", "下单时间", "product_name", "category", "qty", "price", "total", "discount", "pay_amount"]


@pytest.fixture(scope="module")
def result(spark):
    return clean(spark.createDataFrame(DIRTY, NAMES))


def test_lines(result):
    rows = {r["order_id"]: r for r in result.lines.collect()}
    assert len(rows) == 4
    two, three, four = rows["2"], rows["3"], rows["4"]
    assert two["order_time"] is None and two["date"] is None and two["is_weekend"] == 0
    assert two["category"] == "其他" and two["quantity"] == 1 and two["unit_price"] == 8
    assert two["discount"] == 0 and two["actual_amount"] == 8
    assert three["unit_price"] is None  # no price from a quantity of zero
    assert four["quantity"] == 1 and four["unit_price"] == 0 and four["total_amount"] == 0
    assert four["is_weekend"] == 1 and four["weekday"] == 5
    assert all(r["platform"] == "未知平台" and r["status"] == "completed" for r in rows.values())
    assert all(r["customer_id"] == r["order_id"] and r["refund_amount"] == 0 for r in rows.values())


def test_report(result):
    found = {(r["check"], r["column"]): r["value"] for r in result.quality.collect()}
    assert found["raw_rows", None] == "5" and found["clean_rows", None] == "4"
    assert found["duplicates_removed", None] == "1" and found["total_orders", None] == "4"
    assert found["bad_times", "order_time"] == "2"
    assert found["negative_values", "unit_price"] == "1"
    assert found["negative_values", "total_amount"] == "1"
    assert found["missing_customer_id", "customer_id"] == "1"
    assert found["missing_platform", "platform"] == "1"
    assert found["first_date", "date"] == "2024-01-05" and found["last_date", "date"] == "2024-01-06"


def test_minimal_export(spark):
    raw = spark.createDataFrame([("1", "a", "10", "12")], ["order_id", "product_name", "total_amount", "discount"])
    row = clean(raw).lines.first()
    assert row["actual_amount"] == Decimal(-2)  # not clamped
    assert "order_time" not in row.asDict()


def test_missing_fields(spark):
    assert missing_required(["order_id"]) == ["product_name", "total_amount"]
    with pytest.raises(ValueError, match="order id"):
        clean(spark.createDataFrame([("a", "1")], ["product_name", "total_amount"]))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-05 10:00:01.5", "2024-01-05 10:00:01.500000"),
        ("2024/1/5 9:03", "2024-01-05 09:03:00"),
        ("01/05/2024 10:00", "2024-01-05 10:00:00"),
        ("20240105", "2024-01-05 00:00:00"),
        ("2024-01-05T10:00:00", "2024-01-05 10:00:00"),
        ("2024-13-05", None),
        ("", None),
    ],
)
def test_times(spark, text, expected):
    from pyspark.sql import functions as F

    from orderlines.functions.expressions import parse_time

    value = spark.range(1).select(parse_time(F.lit(text))).first()[0]
    assert (str(value) if value else None) == expected


def test_outlier_flag_and_thresholds(spark):
    amounts = [10, 11, 12, 13, 14, 15, 500, 0]
    raw = spark.createDataFrame(
        [(str(i), "p", str(a), "0", str(a), "1") for i, a in enumerate(amounts)],
        ["order_id", "product_name", "total", "discount", "pay_amount", "qty"],
    )
    result = clean(raw)
    assert {r["order_id"] for r in result.lines.where("is_anomaly").collect()} == {"6", "7"}
    found = {r["check"]: r["value"] for r in result.quality.collect()}
    assert found["amount_outliers"] == "2" and found["quantity_outliers"] == "0"
