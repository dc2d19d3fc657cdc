import random

import numpy as np
import pytest

from orderlines.functions.order_statistics import Ordering, column_quantiles


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_rows_at_positions(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, 5, 9]), f"k{i:05d}") for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    ordering = Ordering(df, ["a", "b"])
    expected = sorted(rows)
    found = ordering.at(list(range(0, n, 3)))
    assert ordering.total == n
    assert all(tuple(found[i])[:2] == expected[i] for i in range(0, n, 3))
    ranked = {(r["a"], r["b"]): r["position"] for r in ordering.ranked().collect()}
    assert ranked == {row: i for i, row in enumerate(expected)}


def test_weights(spark):
    df = spark.createDataFrame([(5, 3), (1, 2), (9, 1)], "v int, n int")
    ordering = Ordering(df, ["v"], "n")
    assert [ordering.at([i])[i]["v"] for i in range(6)] == [1, 1, 5, 5, 5, 9]


@pytest.mark.parametrize("kind", ["ties", "spread", "single", "skewed"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "ties": rng.integers(0, 4, 30_000),
        "spread": rng.normal(size=30_000),
        "single": np.array([4.0]),
        "skewed": np.where(rng.random(30_000) < 0.4, 7.0, rng.exponential(5, 30_000)),
    }[kind].astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = column_quantiles(df, {"v": probabilities})["v"]
    assert found == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-12)


def test_quantiles_ignore_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert column_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [2.0], "b": [None]}


def test_quantiles_survive_a_bracket_that_misses(spark, monkeypatch):
    from orderlines.functions import order_statistics

    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    monkeypatch.setattr(order_statistics, "SKETCH_K", 8)
    monkeypatch.setattr(order_statistics, "MARGIN", 0.0)
    found = column_quantiles(df, {"v": [0.25, 0.5]})["v"]
    assert found == [25.0, 50.0]
