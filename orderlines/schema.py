"""The order-line table: canonical columns, header aliases and fixed texts."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

ORDER_LINE = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("order_time", T.TimestampNTZType()),
        T.StructField("date", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("weekday", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("quantity", MONEY),
        T.StructField("unit_price", MONEY),
        T.StructField("total_amount", MONEY),
        T.StructField("discount", MONEY),
        T.StructField("actual_amount", MONEY),
        T.StructField("refund_amount", MONEY),
        T.StructField("status", T.StringType()),
    ]
)

# Position of a line within its source, used wherever "the first value" is asked for.
LINE_NO = "line_no"
# File that a line was read from.
SOURCE_FILE = "source_file"

CALENDAR_COLUMNS = ("date", "hour", "weekday", "is_weekend")
NUMERIC_COLUMNS = (
    "quantity",
    "unit_price",
    "total_amount",
    "actual_amount",
    "discount",
    "refund_amount",
)
REQUIRED_COLUMNS = ("order_id", "product_name", "total_amount")

# The header names under which exports carry each canonical column.
HEADER_ALIASES = {
    "order_id": ["order_id", "订单编号", "orderId", "订单号", "ordernum"],
    "order_time": [
        "order_time", "下单时间", "orderTime", "时间", "pay_time", "支付时间", "完成时间",
    ],
    "customer_id": ["customer_id", "用户编号", "customerId", "会员编号", "user_id", "openid"],
    "product_name": ["product_name", "商品名称", "food_name", "菜品名称", "productName"],
    "category": ["category", "品类", "分类", "product_category", "category_name"],
    "quantity": ["quantity", "数量", "qty", "num"],
    "unit_price": ["unit_price", "单价", "price", "unitPrice"],
    "total_amount": ["total_amount", "总金额", "total", "amount", "原价"],
    "discount": ["discount", "优惠金额", "discount_amount", "立减", "红包"],
    "actual_amount": ["actual_amount", "实付金额", "actualAmount", "实际支付", "pay_amount"],
    "platform": ["platform", "平台", "source", "来源", "platform_name"],
    "status": ["status", "状态", "订单状态", "order_status"],
}

# Defaults written into missing data.
UNKNOWN_PLATFORM = "未知平台"
OTHER_CATEGORY = "其他"
COMPLETED = "completed"
REFUNDED = "refunded"

# Weekday names, Monday first.
WEEKDAY_NAMES = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]
