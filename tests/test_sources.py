import pytest
from pyspark.sql import functions as F

from orderlines import clean, read_orders, read_typed_orders, write_csv, write_parquet
from orderlines.operators.cleaning import resolve_headers
from orderlines.schema import HEADER_ALIASES, ORDER_LINE
from orderlines.sources import readers

ZH = "订单编号,下单时间,会员编号,菜品名称,分类,数量,单价,总金额,优惠金额,实付金额,来源,订单状态\n"
CAMEL = (
    "orderId,orderTime,customerId,productName,product_category,qty,unitPrice,amount,"
    "discount_amount,actualAmount,platform_name,order_status\n"
)


def put(path, text, encoding):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_alias_table_has_no_alias_twice():
    aliases = [a.lower() for names in HEADER_ALIASES.values() for a in names]
    assert len(HEADER_ALIASES) == 12
    assert len(aliases) == len(set(aliases))


def test_gbk_and_utf8_with_mark_are_united(spark, tmp_path):
    a = put(tmp_path / "a.csv", ZH + "1,2026-03-01 12:00:00,c1,可乐,饮品,2,3,6,1,5,美团外卖,completed\n", "gbk")
    b = put(tmp_path / "b.csv", CAMEL + "2,2026/3/2 18:30,c2,米饭,主食,1,2,2,0,2,饿了么,refunded\n", "utf-8-sig")
    lines = read_orders(spark, [a, b])
    rows = {r["order_id"]: r for r in lines.collect()}
    assert rows["1"]["product_name"] == "可乐" and rows["1"]["platform"] == "美团外卖"
    assert rows["2"]["product_name"] == "米饭" and rows["2"]["status"] == "refunded"
    assert rows["1"]["source_file"].endswith("a.csv") and rows["2"]["source_file"].endswith("b.csv")
    cleaned = {r["order_id"]: r for r in clean(lines).lines.collect()}
    assert str(cleaned["2"]["order_time"]) == "2026-03-02 18:30:00"
    assert cleaned["2"]["hour"] == 18 and cleaned["2"]["weekday"] == 0


def test_undecodable_file_is_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_bytes(b"order_id\n\xff\xff\n")
    with pytest.raises(ValueError, match="decode"):
        read_orders(spark, str(path))


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="unsupported"):
        read_orders(spark, "raw.json", format="json")


def test_headers_with_spaces_and_two_candidates():
    found = resolve_headers([" ORDER_ID ", "Amount", "total_amount", "note", "Pay_Time", "时间"])
    assert found == {"order_id": " ORDER_ID ", "total_amount": "total_amount", "order_time": "Pay_Time"}


def test_line_order_within_a_file(spark, tmp_path):
    text = "order_id,product_name,total_amount\n" + "".join(f"{i},p{i},1\n" for i in range(500))
    lines = read_orders(spark, put(tmp_path / "o.csv", text, "utf-8"))
    assert [r[0] for r in lines.orderBy("line_no").select("order_id").collect()] == [str(i) for i in range(500)]


def test_csv_and_parquet_round_trip(spark, tmp_path):
    row = [
        ("1", "2026-03-01 12:14:05.123456", "c", "美团外卖", "可乐", "饮品", "2", "3", "6", "0", "6", "0", "completed"),
    ]
    names = [
        "order_id", "order_time", "customer_id", "platform", "product_name", "category", "quantity",
        "unit_price", "total_amount", "discount", "actual_amount", "refund_amount", "status",
    ]
    lines = clean(spark.createDataFrame(row, names)).lines.select(*ORDER_LINE.fieldNames())
    write_csv(lines, str(tmp_path / "csv"))
    back = read_typed_orders(spark, str(tmp_path / "csv"))
    assert back.collect() == lines.collect()
    write_parquet(lines, str(tmp_path / "parquet"))
    assert (tmp_path / "parquet" / "date=2026-03-01").is_dir()
    assert read_orders(spark, str(tmp_path / "parquet"), format="parquet").select(*ORDER_LINE.fieldNames()).where(
        F.col("date") == "2026-03-01"
    ).count() == 1


def test_the_charset_check_sorts_no_lines(spark, tmp_path):
    """A sort by file would hold a whole split of lines, each with its path, in one task."""
    path = tmp_path / "a.csv"
    path.write_bytes("订单编号,商品名称\n1,菜\n2,茶\n".encode("gbk"))
    for checked, expected in ((True, (False, True)), (False, (True, True))):
        files = readers._inspect(spark, [str(path)], checked)
        plan = files._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" in plan and "Sort" not in plan
        assert files.select("utf8", "gbk").first()[:] == expected
