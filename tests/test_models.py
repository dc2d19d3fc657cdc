import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlines.operators import clustering, forecasting, outliers
from orderlines.operators.quality import screen_orders

# ---- clusters ----


@pytest.fixture(scope="module")
def customers(spark):
    rng = random.Random(1)
    rows = [
        (f"c{g}{i:03d}", 10 + 100 * g + rng.randint(0, 3), 50 - 20 * g, Decimal(1000 - 400 * g + rng.randint(0, 5)))
        for g in range(3)
        for i in range(30)
    ]
    return spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary decimal(28,4)")


def test_clusters_find_planted_groups(customers):
    found = clustering.cluster_customers(customers, k=3, restarts=2)
    pairs = found.customers.select(F.substring("customer_id", 1, 2).alias("g"), "cluster").distinct().collect()
    assert len(pairs) == 3 and len({p["cluster"] for p in pairs}) == 3
    assert [r["count"] for r in found.centers.collect()] == [30, 30, 30]
    best = found.centers.orderBy("recency").first()
    assert best["profile"].endswith("R近/F高/M高")


def test_elbow_falls_and_starts_at_the_total(customers):
    rows = clustering.elbow(customers, max_k=4, restarts=1).orderBy("k").collect()
    costs = [r["inertia"] for r in rows]
    assert costs[0] == 270.0 and costs == sorted(costs, reverse=True)


def test_constant_feature_counts_nothing(spark):
    rows = [(f"c{i}", i, 3, Decimal(i * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary decimal(28,4)")
    assert clustering.elbow(df, max_k=1).first()["inertia"] == 20.0
    assert {r["z_frequency"] for r in clustering.standardize(df).collect()} == {0.0}


# ---- forecasts ----


def series_of(spark, **lengths):
    rows = [
        (name, dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 10 * (i % 7) + i)
        for name, n in lengths.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "series string, date date, revenue double")


def test_lag_features_do_not_see_the_target(spark):
    daily = series_of(spark, a=20)
    rows = forecasting.lag_features(daily).orderBy("date").collect()
    values = [r["revenue"] for r in daily.orderBy("date").collect()]
    assert len(rows) == 13
    for i, row in enumerate(rows, 7):
        assert row["day_num"] == i and row["lag_7"] == values[i - 7] and row["lag_1"] == values[i - 1]
        assert row["rolling_mean_7"] == pytest.approx(sum(values[i - 7 : i]) / 7)
        assert sum(row[f"wd_{d}"] for d in range(7)) == 1


def test_forecast_routes_by_length_and_keeps_bounds(spark):
    found = forecasting.forecast(series_of(spark, short=13, least=14, long=60), days=9)
    rows = found.days.collect()
    by_series = {name: [r for r in rows if r["series"] == name] for name in ("short", "least", "long")}
    assert all(len(x) == 9 for x in by_series.values())
    assert all(0 <= r["lower_bound"] <= r["predicted"] <= r["upper_bound"] for r in rows)
    assert len({r["predicted"] for r in by_series["short"]}) == 1
    quality = {r["series"]: r for r in found.quality.collect()}
    assert quality["short"]["mape"] is None and quality["long"]["n_features"] == 17
    first = min(r["date"] for r in by_series["long"])
    assert first == dt.date(2024, 1, 1) + dt.timedelta(days=60)


def test_mean_forecast(spark):
    rows = forecasting.mean_forecast(series_of(spark, a=3), days=2).orderBy("date").collect()
    assert [(r["predicted"], r["lower_bound"], r["upper_bound"]) for r in rows] == [(111.0, 94.35, 127.65)] * 2


def test_summary_names_the_direction(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 9)]
    rows = [("up", d, 100.0 + i, 90.0, 120.0) for i, d in enumerate(days)]
    rows += [("steep", d, 100.0 + 2 * i, 90.0, 120.0) for i, d in enumerate(days)]
    rows += [("down", d, 100.0 - 2 * i, 90.0, 120.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "series string, date date, predicted double, lower_bound double, upper_bound double")
    trend = {r["series"]: r["trend"] for r in forecasting.forecast_summary(df).collect()}
    assert trend == {"up": "上升 ↗", "steep": "上升 ↗", "down": "下降 ↘"}


# ---- unusual orders ----


def order_lines(spark, n):
    rng = random.Random(2)
    rows = [
        (f"o{i:04d}", f"p{j}", Decimal(rng.randint(8, 12)), Decimal(1), Decimal(rng.randint(8, 12)), Decimal(0), 12, 0)
        for i in range(n)
        for j in range(2)
    ]
    rows.append(("strange", "p9", Decimal(900), Decimal(80), Decimal(900), Decimal(50), 3, 1))
    return spark.createDataFrame(
        rows,
        "order_id string, product_name string, actual_amount decimal(18,4), quantity decimal(18,4),"
        "unit_price decimal(18,4), discount decimal(18,4), hour int, is_weekend int",
    )


def test_forest_finds_the_planted_order(spark):
    lines = order_lines(spark, 600)
    scored = outliers.isolation_forest(lines.repartition(3))
    rows = scored.collect()
    assert min(rows, key=lambda r: r["anomaly_score"])["order_id"] == "strange"
    assert 0.03 <= sum(r["is_anomaly"] for r in rows) / len(rows) <= 0.051
    again = {r["order_id"]: r["anomaly_score"] for r in outliers.isolation_forest(lines.repartition(8)).collect()}
    assert again == {r["order_id"]: r["anomaly_score"] for r in rows}
    verdicts = {r["order_id"]: r["verdict"] for r in outliers.verdicts(screen_orders(lines), scored).collect()}
    assert verdicts["strange"] == "both" and len(verdicts) == 601


def test_forest_on_few_equal_orders(spark):
    lines = order_lines(spark, 3).where("order_id <> 'strange'").withColumn("actual_amount", F.lit(1).cast("decimal(18,4)")).withColumn("unit_price", F.lit(1).cast("decimal(18,4)"))
    assert {r["anomaly_label"] for r in outliers.isolation_forest(lines).collect()} == {1}


# ---- published models -------------------------------------------------------------------------


def test_errors_and_steps_follow_from_the_node_table(spark):
    """In-sample errors by SQL over the nodes, forecasts by walking them one value at a time."""
    import duckdb

    daily = series_of(spark, a=40, b=60)
    found = forecasting.forecast(daily, days=5)
    nodes = found.nodes.toPandas()  # noqa: F841
    scaled = forecasting.scaled_series(daily)
    scales = {r["series"]: r["scale"] for r in scaled.select("series", "scale").distinct().collect()}
    training = forecasting.lag_features(scaled.drop("scale")).toPandas()
    training["scale"] = training["series"].map(scales)
    features = ", ".join(f"CAST({name} AS DOUBLE)" for name in forecasting.FEATURES)
    errors = duckdb.sql(f"""
      WITH RECURSIVE rows AS (SELECT row_number() OVER () AS id, series, revenue, scale, [{features}] AS x FROM training),
      walk AS (
        SELECT id, x, tree, 0 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
        UNION ALL
        SELECT id, x, w.tree, CASE WHEN x[feature + 1] <= threshold THEN n."left" ELSE n."right" END
        FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE feature >= 0
      ),
      predicted AS (
        SELECT id, avg(prediction) AS share FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE feature < 0 GROUP BY id
      )
      SELECT series, round(avg(abs((revenue - share) * scale / (revenue * scale + 0.01))) * 100, 2), round(stddev_pop((revenue - share) * scale), 2)
      FROM rows JOIN predicted USING (id) GROUP BY series ORDER BY series
    """).fetchall()
    quality = {r["series"]: (r["mape"], r["residual_std"]) for r in found.quality.collect()}
    assert errors == [(name, *quality[name]) for name in ("a", "b")]

    table = {(r.tree, r.node): r for r in nodes.itertuples()}
    trees = sorted({tree for tree, _ in table})

    def predict(x):
        total = 0.0
        for tree in trees:
            node = table[tree, 0]
            while node.feature >= 0:
                node = table[tree, node.left if x[forecasting.FEATURES[node.feature]] <= node.threshold else node.right]
            total += node.prediction
        return total / len(trees)

    predicted = {(r["series"], r["date"]): r["predicted"] for r in found.days.collect()}
    for name, n in (("a", 40), ("b", 60)):
        ring = [r["revenue"] for r in scaled.where(F.col("series") == name).orderBy("date").collect()][-7:]
        for step in range(1, 6):
            date = dt.date(2024, 1, 1) + dt.timedelta(days=n - 1 + step)
            mean = sum(ring) / 7
            x = {
                "day_num": n - 1 + step, "month": date.month, "is_weekend": date.weekday() >= 5, "day_of_month": date.day,
                **{f"lag_{k}": ring[-k] for k in (1, 2, 3, 7)}, "rolling_mean_7": mean,
                "rolling_std_7": (sum((v - mean) ** 2 for v in ring) / 6) ** 0.5, **{f"wd_{k}": date.weekday() == k for k in range(7)},
            }
            value = predict(x)
            assert predicted[name, date] == pytest.approx(round(max(value * scales[name], 0), 2), abs=0.011)
            ring = [*ring[1:], value]


def test_scores_follow_from_the_node_table(spark):
    orders = outliers.order_features(order_lines(spark, 300))
    nodes = outliers.grow_forest(orders, trees=7, sample=64)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert len({t for t, _ in table}) == 7 and {r["sample"] for r in table.values()} == {64}
    assert all(table[t, 2 * n]["size"] + table[t, 2 * n + 1]["size"] == r["size"] for (t, n), r in table.items() if r["feature"] >= 0)
    scale = float(outliers._mean_path(64))
    for row in outliers.score_orders(orders, nodes).collect():
        total = 0
        for tree in range(7):
            node = table[tree, 1]
            while node["feature"] >= 0:
                right = row[outliers.FEATURES[node["feature"]]] > node["split"]
                node = table[tree, 2 * node["node"] + right]
            total += node["path"]
        assert row["anomaly_score"] == pytest.approx(-(2 ** -(total / 1e6 / 7 / scale)), abs=1e-9)


def test_clusters_by_brute_force(spark):
    """Lloyd rounds over every customer in plain Python, from the same starts."""
    import hashlib

    rng = random.Random(5)
    rows = [(f"c{i}", rng.randint(0, 40), rng.randint(1, 9), Decimal(rng.randint(10, 500))) for i in range(90)] + [("twin", 5, 2, Decimal(90))] * 4
    df = spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary decimal(28,4)")
    found = clustering.cluster_customers(df, k=3, restarts=4)
    points = [tuple(r) for r in clustering.standardize(df).withColumns(clustering._grid_columns()).select("customer_id", *clustering.GRID).collect()]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    best = None
    for start in range(4):
        distinct = sorted({p[1:] for p in points}, key=lambda p: hashlib.md5(f"42:{start}:{p[0]}:{p[1]}:{p[2]}".encode()).hexdigest())
        centres = [list(map(float, p)) for p in distinct[:3]]
        for _ in range(clustering.ROUNDS):
            groups = [[] for _ in centres]
            for p in points:
                groups[min(range(3), key=lambda k: far(p[1:], centres[k]))].append(p[1:])
            before, centres = centres, [[sum(c) / len(g) for c in zip(*g)] if g else old for g, old in zip(groups, centres)]
            if sum(far(x, y) for x, y in zip(before, centres)) <= clustering.TOLERANCE * clustering.UNIT**2:
                break
        cost = round(sum(min(far(p[1:], c) for c in centres) for p in points) / clustering.UNIT**2, 6)
        if best is None or cost < best[0]:
            best = cost, sorted(centres)
    labels = sorted((p[0], min(range(3), key=lambda k: far(p[1:], best[1][k]))) for p in points)
    assert sorted((r["customer_id"], r["cluster"]) for r in found.customers.collect()) == labels
    assert found.inertia == round(best[0], 2)


def test_clusters_of_few_or_no_customers(spark):
    schema = "customer_id string, recency int, frequency long, monetary decimal(28,4)"
    two = spark.createDataFrame([("a", 1, 1, Decimal(1)), ("b", 9, 2, Decimal(5)), ("x", None, 1, Decimal(1))], schema)
    assert sorted(r["cluster"] for r in clustering.cluster_customers(two).customers.collect()) == [0, 1]
    assert [r["inertia"] for r in clustering.elbow(two, max_k=3).orderBy("k").collect()] == [6.0, 0.0, 0.0]
    none = clustering.cluster_customers(spark.createDataFrame([], schema))
    assert none.customers.count() == 0 and none.inertia == 0.0


def test_samples_are_the_least_draws_and_no_digest_is_split_by_a_pattern(spark):
    import hashlib

    rows = [(f"o{i}", *[float((i * k) % 97) for k in (1, 3, 7, 11, 13)]) for i in range(400)]
    orders = spark.createDataFrame(rows, "order_id string, " + ", ".join(f"{c} double" for c in outliers.FEATURES))
    nodes = outliers.grow_forest(orders.repartition(3), trees=6, sample=16)
    assert "split(" not in nodes._jdf.queryExecution().analyzed().toString()

    def draw(tree, order):
        digest = hashlib.md5(f"42:{tree // 4}:{order}".encode()).hexdigest()
        return digest[tree % 4 * 8 : tree % 4 * 8 + 8]

    roots = {r["tree"]: r for r in nodes.where("node = 1").collect()}
    assert sorted(roots) == list(range(6))
    for tree, root in roots.items():
        sample = sorted(rows, key=lambda r: (draw(tree, r[0]), r[0]))[:16]
        digest = hashlib.md5(f"node:42:{tree}:1".encode()).hexdigest()
        values = [r[1 + root["feature"]] for r in sample]
        assert root["sample"] == 16
        assert root["split"] == pytest.approx(min(values) + int(digest[8:21], 16) / 2**52 * (max(values) - min(values)))


def test_cluster_sums_are_exact_and_ties_go_to_the_first():
    import numpy as np

    for scale in (1, 10**12):
        values = np.arange(1, 3001, dtype=np.int64) * scale + 1
        cluster = np.arange(3000) % 3
        sums = clustering._sums(cluster, clustering._exact(values), 3)
        assert sums.tolist() == [sum(int(v) for v in values[n::3]) for n in range(3)]
    points = [np.array([0.0, 1.0, 2.0]), np.zeros(3), np.zeros(3)]
    cluster, far = clustering._closest(points, np.array([[0.0, 0, 0], [2.0, 0, 0], [2.0, 0, 0]]))
    assert cluster.tolist() == [0, 0, 1] and far.tolist() == [0.0, 1.0, 0.0]
