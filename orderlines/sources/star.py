"""Order lines from the star-schema tables and from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlines.functions.expressions import calendar_columns
from orderlines.schema import COMPLETED, LINE_NO, MONEY, REFUNDED

CENTS = "decimal(18,2)"
RATE = "decimal(4,2)"


def star_lines(spark: SparkSession, sf_dir: str, products: bool = True, dealt: int | None = None) -> DataFrame:
    """``lineitem`` with its order and, where asked for, its product.

    Joins are left to Spark: it broadcasts a side only when its size is small enough, and adaptive
    execution splits the partitions of an order or part that holds many lines. The text
    ``order_id`` keeps the later grouping apart from the join, so such a split stays possible.

    With ``dealt`` the join with the orders comes last and on that text, in so many partitions: the lines leave it
    as ``write_bucketed`` deals them out, and need no shuffle of their own for that.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines, order_id = items, F.col("l_orderkey").cast("string")
    if dealt is None:
        lines = lines.join(orders, items.l_orderkey == orders.o_orderkey)
    if products:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet")
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
    if dealt is not None:
        lines = lines.withColumn("_order", order_id).repartition(dealt, "_order")
        orders = orders.withColumn("_of", F.col("o_orderkey").cast("string")).repartition(dealt, "_of")
        lines, order_id = lines.join(orders, F.col("_order") == F.col("_of")), F.col("_order")

    price = F.col("l_extendedprice").cast(CENTS)
    discount = (price * F.col("l_discount").cast(RATE)).cast(MONEY)
    actual = (price.cast(MONEY) - discount).cast(MONEY)
    refunded = F.col("l_returnflag") == "R"
    named = {
        "order_id": order_id,
        LINE_NO: F.col("l_linenumber").cast("long"),
        "order_time": F.col("o_orderdate"),
        **calendar_columns(F.col("o_orderdate")),
        "customer_id": F.col("o_custkey").cast("string"),
        "platform": F.col("o_orderpriority"),
        "quantity": F.col("l_quantity").cast(MONEY),
        "unit_price": F.try_divide(price.cast(MONEY), F.col("l_quantity").cast(MONEY)).cast(MONEY),
        "total_amount": price.cast(MONEY),
        "discount": discount,
        "actual_amount": actual,
        "refund_amount": F.when(refunded, actual).otherwise(F.lit(0).cast(MONEY)),
        "status": F.when(refunded, REFUNDED).otherwise(COMPLETED),
    }
    if products:
        named["product_name"] = F.col("p_name")
        named["category"] = F.col("p_type")
    return lines.select(*[column.alias(name) for name, column in named.items()])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one-line orders; the only table with times of day."""
    value = F.col("value").cast(MONEY)
    named = {
        "order_id": F.col("event_id").cast("string"),
        LINE_NO: F.lit(1).cast("long"),
        "order_time": F.col("ts"),
        **calendar_columns(F.col("ts")),
        "customer_id": F.col("user_id").cast("string"),
        "platform": F.col("event_type"),
        "product_name": F.col("event_type"),
        "category": F.col("event_type"),
        "quantity": F.lit(1).cast(MONEY),
        "unit_price": value,
        "total_amount": value,
        "discount": F.lit(0).cast(MONEY),
        "actual_amount": value,
        "refund_amount": F.lit(0).cast(MONEY),
        "status": F.lit(COMPLETED),
    }
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[column.alias(name) for name, column in named.items()])


def raw_export(spark: SparkSession, sf_dir: str, platform: bool = True) -> DataFrame:
    """``lineitem`` as a platform would export it: aliased headers, text, and flaws.

    Unreadable times, blank and negative numbers, blank categories and repeated rows follow from
    the keys, so that a query elsewhere can repeat them.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = items.join(orders, items.l_orderkey == orders.o_orderkey).join(
        parts, items.l_partkey == parts.p_partkey
    )
    number, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    price = F.col("l_extendedprice").cast(CENTS)
    retail = F.col("p_retailprice").cast(CENTS)
    discount = price * F.col("l_discount").cast(RATE)
    named = {
        "订单编号": F.col("l_orderkey").cast("string"),
        " 下单时间 ": F.when(number == 7, "unknown").otherwise(
            F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")
        ),
        "会员编号": F.col("o_custkey").cast("string"),
        "菜品名称": F.col("p_name"),
        "分类": F.when(part % 40 != 5, F.col("p_type")),
        "QTY": F.when(supplier % 10 != 3, F.col("l_quantity").cast("int").cast("string")),
        "单价": F.when(part % 30 != 2, F.when(part % 50 == 1, -retail).otherwise(retail)).cast(
            "string"
        ),
        "amount": price.cast("string"),
        "优惠金额": F.when(number != 5, discount.cast(MONEY)).cast("string"),
        "pay_amount": F.when(number != 6, (price - discount).cast(MONEY)).cast("string"),
        "订单状态": F.when(F.col("l_returnflag") == "R", REFUNDED).otherwise(COMPLETED),
    }
    if platform:
        named["来源"] = F.col("o_orderpriority")
    copies = F.when(number == 1, 2).otherwise(1)
    return lines.select(
        *[column.alias(name) for name, column in named.items()],
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
    ).drop("_copy")
