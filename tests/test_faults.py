"""Faults found in review, each with the smallest case that shows it."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from orderlines.functions import expressions, storage
from orderlines.functions.storage import materialize, new_path, release
from orderlines.operators import basket, diagnosis, forecasting, metrics, outliers, quality
from orderlines.operators.cleaning import coerce, deduplicate
from orderlines.plans import queries
from orderlines.plans.preparation import clean
from orderlines.plans.report import diagnose
from orderlines.sources.readers import read_orders
from orderlines.sources.star import star_lines
from orderlines.sources.writers import write_parquet

EXPORT = "order_id,product_name,total_amount,discount,order_time\n1,tea,10,1,2026-01-05 11:30:00\n1,cake,20,0,2026-01-05 11:30:00\n"


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT, encoding="utf-8")
    return str(path)


def test_lift_of_very_frequent_items(spark):
    many = 4_000_000_000
    rows = [(["a"], many, 2 * many), (["b"], many, 2 * many), (["a", "b"], many // 2, 2 * many)]
    itemsets = spark.createDataFrame(rows, basket.ITEMSETS)
    assert {r["lift"] for r in basket.association_rules(itemsets, 0.0).collect()} == {1.0}


def test_the_same_export_twice_counts_once(spark, export, tmp_path):
    again = tmp_path / "again.csv"
    again.write_text(EXPORT, encoding="utf-8")
    lines = deduplicate(coerce(read_orders(spark, [export, str(again)])))
    assert lines.count() == 2 and lines.agg(F.sum("total_amount")).first()[0] == 30
    assert {r["_copies"] for r in lines.collect()} == {2}


def test_clean_lines_can_be_read_back(spark, export, tmp_path):
    first = clean(read_orders(spark, export)).lines
    write_parquet(first, str(tmp_path / "clean"))
    back = clean(read_orders(spark, str(tmp_path / "clean"), format="parquet")).lines
    key = ["order_id", "product_name", "total_amount", "line_no", "source_file"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, first.select(*key).collect()))


def test_many_files_of_two_headers_and_charsets(spark, tmp_path):
    for i in range(30):
        header = ("订单编号,商品名称,总金额", "orderId,productName,amount")[i % 2]
        text = f"{header}\n{i},菜{i},{i}\n"
        (tmp_path / f"f{i}.csv").write_bytes(text.encode("gbk" if i % 3 == 0 else "utf-8"))
    found = read_orders(spark, [str(tmp_path / f"f{i}.csv") for i in range(30)]).collect()
    assert sorted((int(r["order_id"]), r["product_name"]) for r in found) == [(i, f"菜{i}") for i in range(30)]
    (tmp_path / "bad.csv").write_bytes(b"order_id,product_name\n1,\xff\xff\n")
    with pytest.raises(ValueError, match="bad.csv"):
        read_orders(spark, [str(tmp_path / "bad.csv"), str(tmp_path / "f1.csv")])


def test_nan_is_missing_in_the_profile(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (3.0, None), (None, "y")], "v double, t string")
    for approx in (False, True):
        v, t = sorted(quality.profile(df, approx=approx).collect(), key=lambda r: r["position"])
        assert (v["count"], v["missing"], v["mean"], v["min"], v["max"], v["nunique"]) == (2, 2, 2.0, 1.0, 3.0, 2)
        assert (t["count"], t["missing"], t["top"], t["freq"], t["unique"]) == (3, 1, "x", 2, 2)


def test_calendar_columns_follow_from_the_time(spark):
    lines = spark.sql(
        "SELECT '1' order_id, 'c' customer_id, 'p' platform, 'completed' status, 'tea' product_name,"
        " TIMESTAMP_NTZ'2026-01-05 11:30:00' order_time, 10.0D total_amount, 9.0D actual_amount, 1.0D discount,"
        " 0.0D refund_amount, 1.0D quantity, 10.0D unit_price"
    )
    assert str(metrics.order_rollup(lines).first()["date"]) == "2026-01-05"
    assert metrics.daily_trend(lines).count() == metrics.daily_features(lines).count() == 1
    assert metrics.hourly_orders(lines).first()[:2] == (0, 11)
    assert outliers.order_features(lines).first()["order_hour"] == 11


def test_forecasts_follow_the_scale_of_a_series(spark):
    rows = [(s, f"2026-01-{d + 1:02d}", f * (100.0 + 10 * ((d * 7) % 5))) for s, f in (("a", 1.0), ("b", 1024.0)) for d in range(28)]
    daily = spark.createDataFrame(rows, "series string, date string, revenue double").withColumn("date", F.to_date("date"))
    found = {(r["series"], r["date"]): r["predicted"] for r in forecasting.forecast(daily, 3).days.collect()}
    small = [v for (s, _), v in sorted(found.items()) if s == "a"]
    large = [v for (s, _), v in sorted(found.items()) if s == "b"]
    assert len(small) == 3 and large == pytest.approx([1024 * v for v in small], rel=1e-4)


def test_forest_takes_its_parameters_and_one_rule(spark):
    lines = spark.range(3000).select(
        F.col("id").cast("string").alias("order_id"), F.lit("p").alias("product_name"), F.lit(1).alias("hour"),
        F.lit(0).alias("is_weekend"), (F.col("id") % 17).cast("double").alias("actual_amount"),
        F.lit(1.0).alias("quantity"), F.lit(2.0).alias("unit_price"), F.lit(0.0).alias("discount"),
    ).withColumn("actual_amount", F.when(F.col("order_id").endswith("07"), 9000.0).otherwise(F.col("actual_amount")))
    scored = outliers.isolation_forest(lines, trees=40, sample=64)
    assert {r["total_amount"] for r in scored.orderBy("anomaly_score").limit(20).collect()} == {9000.0}


def files_below(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


def test_release_removes_what_was_written(spark):
    release(spark)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = len(files_below(folder))
    assert materialize(spark.range(10), "numbers").count() == 10
    spark.range(3).write.parquet(new_path(spark, "sink"))
    assert len(files_below(folder)) > before
    release(spark)
    assert len(files_below(folder)) == before


def test_without_a_shared_folder_nothing_goes_to_a_temporary_one(spark, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: None)
    before = set(os.listdir(tempfile.gettempdir()))
    kept = materialize(spark.range(10), "numbers")
    assert kept.is_cached and kept.count() == 10
    assert new_path(spark, "sink").startswith(spark.conf.get("spark.sql.warehouse.dir"))
    release(spark)
    assert not kept.is_cached
    new = set(os.listdir(tempfile.gettempdir())) - before
    assert not [name for name in new if name.startswith("orderlines")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_sorts_once(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr(
        "CAST(o_orderkey AS STRING) order_id", "o_orderdate order_time", "'c' customer_id", "'p' platform", "'x' status",
        "'n' product_name", "o_totalprice total_amount", "o_totalprice actual_amount", "0D discount", "0D refund_amount",
    )
    plan = plan_of(metrics.order_rollup(lines))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert plan.rindex("SortAggregate") < plan.index("Exchange")  # the tree is printed from the top down


def test_settle_deletes_only_what_came_since(spark):
    import os

    from orderlines.functions.storage import marked, materialize, settle

    first = materialize(spark.range(5), "first")
    mark = marked(spark)
    step = materialize(first.where("id > 1"), "step")
    before = [path for path in step.inputFiles()]
    result = settle(step.where("id > 2"), "result", mark)
    assert result.count() == 2 and first.count() == 5
    assert before and not any(os.path.exists(path.removeprefix("file://")) for path in before)


def test_diagnosis_runs_only_what_its_sections_need(spark, monkeypatch):
    from orderlines.plans import queries, report

    def never(*_, **__):
        raise AssertionError("not needed by these sections")

    for name in ("mine_rules", "rfm_segments", "forecast", "isolation_forest"):
        monkeypatch.setattr(report, name, never)
    rows = queries.QUERIES["r6_facts"](spark, "/root/testdata/sf0.001").collect()
    assert {r["section"] for r in rows} == {"summary", "volatility", "best sellers", "slow movers"}


def test_outlying_orders_are_written_before_the_join(spark):
    """Of the totals of all orders Spark knows no more than their size, and would shuffle the lines by order."""
    lines = spark.range(40_000).selectExpr("CAST(id AS STRING) order_id", "CAST(IF(id % 9999 = 0, 1000, id % 7) AS DECIMAL(18,4)) actual_amount")
    lines = materialize(lines)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        flagged = quality.flag_outlier_orders(lines, quality.screen_orders(lines))
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert flagged.where("is_anomaly").count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_quality_report_counts_orders_from_their_totals(spark):
    lines = spark.sql("SELECT '1' order_id, 1 _copies, CAST(2 AS DECIMAL(18,4)) actual_amount UNION ALL SELECT '2', 2, 3 UNION ALL SELECT '2', 1, 4 UNION ALL SELECT NULL, 1, 5")
    screen = quality.screen_orders(lines)
    for given in (screen, None):
        report = quality.quality_report(lines.columns, lines, given)
        assert report.where("check = 'total_orders'").first()["value"] == "2"
        distinct = "count(distinct order_id" in report._jdf.queryExecution().optimizedPlan().toString().lower()
        assert distinct == (given is None)


def test_first_hours_are_merged_without_sorting_lines(spark):
    """First values of whole numbers, at any position and of either sign, with nulls, from a hash table."""
    least, most = -(2**63), 2**63 - 1
    rows = [("a", least, 5), ("a", None, 9), ("a", None, 7), ("b", most, -(2**31)), ("b", most, 3), ("c", 2, None), ("c", 3, 2**31 - 1), ("d", 1, None), ("e", -1, 4), ("e", 0, 1)]
    df = spark.createDataFrame(rows, "k string, line_no long, hour int")
    assert expressions.can_place(df, "hour")
    both = df.groupBy("k").agg(
        expressions.number_in(F.min(expressions.placed_number(df, "hour"))).alias("placed"), expressions.first_value(df, "hour").alias("sorted")
    )
    found = {r["k"]: (r["placed"], r["sorted"]) for r in both.collect()}
    assert {k: v[0] for k, v in found.items()} == {"a": 7, "b": -(2**31), "c": 2**31 - 1, "d": None, "e": 4}
    assert all(a == b for a, b in found.values())
    lines = star_lines(spark, "/root/testdata/sf0.001")
    assert "SortAggregate" not in outliers.order_features(lines)._jdf.queryExecution().executedPlan().toString()


# ---- disk of the diagnosis ------------------------------------------------------------------


def star_tables(folder, orders, order_of="i // 4"):
    """Star tables with four lines per order, unless ``order_of`` the line says otherwise."""
    import duckdb

    tables = {
        "lineitem": f"""SELECT {order_of} AS l_orderkey, i * 7 % 20 AS l_partkey, i % 4 + 1 AS l_linenumber, i % 5 + 1.0 AS l_quantity,
            i * 37 % 900 + 10.5 AS l_extendedprice, (i % 9) / 100 AS l_discount, substr('NRA', i % 3 + 1, 1) AS l_returnflag
            FROM range({4 * orders}) AS t(i)""",
        "orders": f"SELECT i AS o_orderkey, i * 3 % 11 AS o_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(i % 40 AS INT)) AS o_orderdate, (i % 5)::VARCHAR AS o_orderpriority FROM range({orders}) AS t(i)",
        "part": "SELECT i AS p_partkey, 'p' || (i % 6) AS p_name, 't' || (i % 2) AS p_type FROM range(20) AS t(i)",
    }
    for name, select in tables.items():
        duckdb.sql(f"COPY ({select}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_diagnosis_leaves_nothing_but_its_rows(spark, tmp_path, monkeypatch):
    """Lines, intermediates and shuffles stayed on disk until the session ended."""
    folder = star_tables(tmp_path, 150)
    lines = materialize(star_lines(spark, folder), "lines")
    sections = [section for section in diagnosis.SECTIONS if section != "forecast"]
    expected = sorted(map(str, diagnose(lines, min_support=queries.PAIR_SUPPORT, sections=sections).collect()))
    release(spark)
    shared = spark.conf.get("spark.checkpoint.dir")
    before, tables = set(os.listdir(shared)), spark.catalog.listTables()
    found = queries.r6_all_but_forecast(spark, folder)
    (kept,) = set(os.listdir(shared)) - before
    assert kept.startswith("orderlines-diagnosis-") and spark.catalog.listTables() == tables
    assert sorted(map(str, found.collect())) == expected
    release(spark)
    assert set(os.listdir(shared)) == before
    # Without a shared folder the lines stay: the rows are computed from them.
    monkeypatch.setattr(storage, "shared_folder", lambda spark: None)
    monkeypatch.setattr(queries, "shared_folder", lambda spark: None)
    assert sorted(map(str, queries.r6_all_but_forecast(spark, folder).collect())) == expected
    release(spark)


def test_diagnosis_lays_no_lines_by_an_order_that_fills_a_bucket(spark, tmp_path, monkeypatch):
    folder = star_tables(tmp_path, 60, "CASE WHEN i % 2 = 1 THEN 0 ELSE i // 4 END")
    by_order = sorted(map(str, queries.r6_facts(spark, folder).collect()))
    monkeypatch.setattr(queries, "BUCKET_LINES", 100)
    lines, table = queries._laid_out(spark, folder)
    assert table is None and lines.count() == 240
    assert sorted(map(str, queries.r6_facts(spark, folder).collect())) == by_order


@pytest.mark.parametrize("orders", [0, 15_000])
def test_lines_are_laid_by_order_where_no_order_stands_out(spark, tmp_path, orders):
    lines, table = queries._laid_out(spark, star_tables(tmp_path, orders))
    assert lines.count() == 4 * orders
    spark.sql(f"DROP TABLE {table}")


def test_lines_by_order_are_ranked_and_counted_without_a_shuffle_by_order(spark, tmp_path):
    folder = star_tables(tmp_path, 80)
    lines, table = queries._laid_out(spark, folder)
    plain = materialize(star_lines(spark, folder), "lines")
    ranked = metrics.product_ranking(lines, by_order=True)
    assert "Exchange hashpartitioning(product_name" in plan_of(ranked) and "order_id" not in "".join(
        line for line in plan_of(ranked).splitlines() if "Exchange hashpartitioning" in line
    )
    assert ranked.collect() == metrics.product_ranking(plain).collect()
    assert "Exchange" not in plan_of(basket.order_items(lines))
    rows = sorted(map(str, basket.frequent_itemsets(lines, 0.02, by_order=True).collect()))
    assert len(rows) > 6 and rows == sorted(map(str, basket.frequent_itemsets(plain, 0.02).collect()))
    # Dealt by the join already, each task writes one file of one bucket.
    buckets = [f.rpartition("_")[2] for f in map(os.path.basename, lines.inputFiles())]
    assert len(buckets) == len(set(buckets)) and set(plain.columns) - set(lines.columns) == {"date", "hour", "weekday", "is_weekend"}
    spark.sql(f"DROP TABLE {table}")


def test_shuffles_are_dropped_with_their_job(spark):
    def shuffles():
        blocks = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
        return blocks.size()

    name = storage._DROP_SHUFFLES
    before = spark.conf.get(name, None)
    with storage.shuffles_dropped(spark):
        held = shuffles()
        again = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        assert materialize(again, "counts").count() == 7
        assert shuffles() <= held
        # What a job has dropped is made again for the next.
        assert again.count() == 7 == len(again.collect())
    assert spark.conf.get(name, None) == before


def test_forest_deletes_the_features_that_its_scores_repeat(spark, tmp_path):
    release(spark)
    lines = star_lines(spark, star_tables(tmp_path, 60))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    scored = outliers.isolation_forest(lines, trees=5, sample=16)
    names = {name.rpartition("-")[0] for name in set(os.listdir(shared)) - before}
    assert "orderlines-scores" in names and "orderlines-order-features" not in names
    assert scored.count() == 60
    release(spark)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
