import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlines.functions.segments import segment_of
from orderlines.operators import rfm


def values_of(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary decimal(28,4)")


@pytest.mark.parametrize("n", [3, 4, 5, 60, 61])
def test_frequency_and_spend_follow_rank_bins(spark, n):
    rng = random.Random(n)
    rows = [(f"c{i:04d}", i, rng.choice([1, 1, 2, 7]), None) for i in range(n)]
    rows = [(c, r, f, __import__("decimal").Decimal(rng.randint(0, 9))) for c, r, f, _ in rows]
    scored = rfm.rfm_scores(values_of(spark, rows).repartition(6)).orderBy("customer_id").toPandas()
    for column, score in (("frequency", "F_score"), ("monetary", "M_score")):
        ranks = scored[column].astype(float).rank(method="first")
        assert list(scored[score]) == list(pd.qcut(ranks, 3, labels=[1, 2, 3]).astype(int))


def test_recency_follows_value_bins(spark):
    for n in (3, 4, 5, 50):
        recency = random.Random(n).sample(range(1, 1000, 7), n)
        rows = [(f"c{i}", r, 1, 0) for i, r in enumerate(recency)]
        rows = [(c, r, f, __import__("decimal").Decimal(m)) for c, r, f, m in rows]
        scored = rfm.rfm_scores(values_of(spark, rows)).toPandas()
        thirds = sorted(recency)
        for r, score in zip(scored["recency"], scored["R_score"]):
            # Position p of the value is in the first third when 3p < n - 1.
            p = thirds.index(r)
            assert score == (3 if 3 * p < n - 1 else 2 if 3 * p < 2 * (n - 1) else 1)


def test_equal_recency_gets_one_score(spark):
    from decimal import Decimal

    rows = [(f"c{i}", 5, i, Decimal(i)) for i in range(9)]
    assert {r["R_score"] for r in rfm.rfm_scores(values_of(spark, rows)).collect()} == {3}


def expected_segment(r, f, m):
    if r == 3 and f == 3 and m > 1:
        return "重要价值"
    if r == 3 and f == 2 and m > 1:
        return "潜力客户"
    if f == 1:
        if r > 1:
            return "重要保持" if m > 1 else "新客户" if r == 3 else "普通客户"
        return "流失高价值" if m > 1 else "流失客户"
    if r == 1:
        return "重要挽留" if m > 1 else "一般价值"
    return "普通客户"


def test_all_27_segments(spark):
    scores = list(itertools.product((1, 2, 3), repeat=3))
    df = spark.createDataFrame(scores, "r int, f int, m int")
    for row in df.withColumn("s", segment_of(F.col("r"), F.col("f"), F.col("m"))).collect():
        assert row["s"] == expected_segment(row["r"], row["f"], row["m"])


def test_recency_counts_whole_days(spark):
    import datetime as dt
    from decimal import Decimal

    lines = spark.createDataFrame(
        [
            ("1", "a", dt.datetime(2024, 1, 1, 23), Decimal(5)),
            ("2", "b", dt.datetime(2024, 1, 3, 1), Decimal(5)),
            ("3", "b", dt.datetime(2024, 1, 2, 1), None),
            ("4", None, dt.datetime(2024, 1, 2, 1), Decimal(1)),
        ],
        "order_id string, customer_id string, order_time timestamp_ntz, actual_amount decimal(18,4)",
    )
    rows = {r["customer_id"]: r for r in rfm.rfm_values(lines).collect()}
    assert rows["a"]["recency"] == 2 and rows["b"]["recency"] == 1
    assert rows["b"]["frequency"] == 2 and rows["b"]["monetary"] == 5 and set(rows) == {"a", "b"}
    fixed = {r["customer_id"]: r["recency"] for r in rfm.rfm_values(lines, dt.datetime(2024, 1, 2, 12)).collect()}
    assert fixed == {"a": 0, "b": -1}
