"""Unusual orders by an isolation forest (Liu, Ting and Zhou, 2008).

All chance comes from MD5: which orders a tree draws, and which feature a node splits where. So a forest is a
function of the orders, published as a table of nodes, and any engine can grow and walk the same one.
Leaves hold their path length in whole millionths, so the sum over trees does not depend on its order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, log2
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlines.functions.expressions import can_place, first_value, number_in, placed_number, total, with_calendar
from orderlines.functions.order_statistics import column_quantiles
from orderlines.functions.storage import marked, materialize, settle
from orderlines.operators.quality import OrderScreen

FEATURES = ["total_amount", "item_count", "total_quantity", "avg_unit_price", "discount_total"]
TREES = 100
SAMPLE = 256
SEED = 42
#: Hex digits of a draw, and draws that one digest gives.
DRAW_DIGITS = 8
DRAWS = 32 // DRAW_DIGITS
#: Whole units of a path length, and decimals of a score.
PATH_UNIT = 1_000_000
SCORE_DECIMALS = 9


def order_features(lines: DataFrame) -> DataFrame:
    """One row per order: amounts, items, quantity, price, and when it was placed.

    Items are merged per order and product first, which spreads a very large order over tasks and
    makes the distinct count a plain count. First values travel as ``placed_number``, so that neither step sorts.
    """
    lines = with_calendar(lines)
    placed = {c: can_place(lines, c) for c in ("hour", "is_weekend")}

    def first(c: str) -> Column:
        return F.min(placed_number(lines, c)) if placed[c] else first_value(lines, c)

    def first_of_items(c: str) -> Column:
        return number_in(F.min(c)) if placed[c] else first_value(per_item, c)

    per_item = (
        lines.where(F.col("order_id").isNotNull())
        .groupBy("order_id", "product_name")
        .agg(
            total(F.col("actual_amount")).alias("amount"),
            total(F.col("quantity")).alias("quantity"),
            F.sum("unit_price").alias("prices"),
            F.count("unit_price").alias("n_prices"),
            total(F.col("discount")).alias("discount"),
            *[first(c).alias(c) for c in placed],
            *([F.min("line_no").alias("line_no")] if "line_no" in lines.columns else []),
        )
    )
    return per_item.groupBy("order_id").agg(
        F.sum("amount").cast("double").alias("total_amount"),
        F.count("product_name").alias("item_count"),
        F.sum("quantity").cast("double").alias("total_quantity"),
        F.coalesce(
            F.try_divide(F.sum("prices").cast("double"), F.sum("n_prices").cast("double")),
            F.lit(0.0),
        ).alias("avg_unit_price"),
        F.sum("discount").cast("double").alias("discount_total"),
        first_of_items("hour").alias("order_hour"),
        first_of_items("is_weekend").alias("is_weekend"),
    )


def isolation_forest(
    lines: DataFrame, contamination: float = 0.05, trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Score every order (lower is stranger) and label the lowest share of them -1, others 1.

    Each of ``trees`` trees is grown on ``sample`` orders of its own, to a depth of log2 of that.
    """
    mark = marked(lines.sparkSession)
    orders = materialize(order_features(lines), "order-features")
    nodes = grow_forest(orders, trees, sample)
    scored = settle(score_orders(orders, nodes), "scores", mark)
    (cut,) = column_quantiles(scored, {"anomaly_score": [contamination]})["anomaly_score"]
    strange = F.col("anomaly_score") < F.lit(cut).cast("double")
    return scored.withColumn("anomaly_label", F.when(strange, -1).otherwise(1)).withColumn(
        "is_anomaly", strange
    )


#: The nodes of a forest: root 1, children 2n (at most split) and 2n + 1. ``feature`` counts from 0 and is -1 at a
#: leaf; ``size`` is the sample's rows at the node, ``sample`` those of the tree, ``path`` a leaf's path length in PATH_UNIT.
NODES = "tree int, node int, feature int, split double, size int, sample int, path long"


def grow_forest(orders: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The node table of a forest: at most trees * 2 * sample rows, whatever the number of orders.

    Each tree draws by a digest of tree and order. About twice the sample passes per tree, of which
    the tree keeps the smallest draws, so samples are exact in size and independent of the
    partitioning. An order is repeated only for the trees that drew it.
    """
    share = 2 * sample / max(1, orders.count())
    # Below all draws there are, or below the share of them.
    bound = "g" if share >= 1 else f"{int(share * 16**DRAW_DIGITS):0{DRAW_DIGITS}x}"

    digests = [
        F.md5(F.concat_ws(":", F.lit(SEED), F.lit(block), F.col("order_id").cast("string")).cast("binary"))
        for block in range((trees - 1) // DRAWS + 1)
    ]
    pieces = [F.substring("digest", at * DRAW_DIGITS + 1, DRAW_DIGITS) for at in range(DRAWS)]
    # Nearly all digests are dropped as they are, before their draws are made rows.
    lucky = orders.select("order_id", *FEATURES, F.posexplode(F.array(*digests)).alias("block", "digest")).where(
        reduce(or_, [piece < bound for piece in pieces])
    )
    draws = [F.struct((F.col("block") * DRAWS + at).alias("tree"), piece.alias("draw")) for at, piece in enumerate(pieces)]
    members = (
        lucky.select("order_id", *FEATURES, F.inline(F.array(*draws)))
        .where((F.col("tree") < trees) & (F.col("draw") < bound))
        .withColumns({"order_id": F.col("order_id").cast("string"), **{c: F.col(c).cast("double") for c in FEATURES}})
    )
    depth = max(1, ceil(log2(sample)))
    return members.groupBy("tree").applyInPandas(_tree_builder(sample, depth), NODES)


def _tree_builder(sample: int, limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Builds one tree from the drawn orders of its group, about twice the sample."""
    features = FEATURES

    def build(drawn: pd.DataFrame) -> pd.DataFrame:
        tree = int(drawn["tree"].iloc[0])
        chosen = drawn.sort_values(["draw", "order_id"]).head(sample)
        points = chosen[features].to_numpy(dtype=float)
        nodes = []
        open_nodes = [(1, np.arange(len(points)), 0)]
        while open_nodes:
            node, rows, depth = open_nodes.pop()
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            varying = np.flatnonzero(high > low)
            feature, split = -1, 0.0
            path = round((depth + float(_mean_path(len(rows)))) * PATH_UNIT)
            if depth < limit and len(rows) > 1 and len(varying):
                digest = hashlib.md5(f"node:{SEED}:{tree}:{node}".encode()).hexdigest()
                feature = int(varying[int(digest[:8], 16) % len(varying)])
                split = float(low[feature] + int(digest[8:21], 16) / 2**52 * (high[feature] - low[feature]))
                left = points[rows, feature] <= split
                open_nodes.append((2 * node, rows[left], depth + 1))
                open_nodes.append((2 * node + 1, rows[~left], depth + 1))
            nodes.append((tree, node, feature, split, len(rows), len(points), path))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "size", "sample", "path"])

    return build


def _mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    long = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def score_orders(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """``orders`` with ``anomaly_score``: all trees of a node table are walked without a join."""
    return orders.withColumn("anomaly_score", _scorer(nodes.toPandas())(*[F.col(c).cast("double") for c in FEATURES]))


def _scorer(nodes: pd.DataFrame):
    """Pandas UDF that walks a batch of orders down all trees at once, level by level."""
    slots = int(nodes["node"].max()) + 1 if len(nodes) else 2
    depth = slots.bit_length() - 1
    trees = sorted(nodes["tree"].unique()) if len(nodes) else []
    place = {tree: i for i, tree in enumerate(trees)}
    feature = np.full((len(trees), slots), -1, dtype=np.int64)
    split = np.zeros((len(trees), slots))
    path = np.zeros((len(trees), slots), dtype=np.int64)
    index = (nodes["tree"].map(place).to_numpy(dtype=int), nodes["node"].to_numpy(dtype=int))
    feature[index], split[index], path[index] = nodes["feature"], nodes["split"], nodes["path"]
    samples = nodes.groupby("tree")["sample"].first()
    scale = float(_mean_path(samples.to_numpy()).mean()) if len(samples) else 0.0
    scale = scale if scale > 0 else 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            rows = np.arange(len(points))
            paths = np.zeros(len(points), dtype=np.int64)
            for t in range(len(feature)):
                node = np.ones(len(points), dtype=np.int64)
                for _ in range(depth):
                    f = feature[t, node]
                    right = points[rows, f] > split[t, node]
                    node = np.where(f >= 0, 2 * node + right, node)
                paths += path[t, node]
            mean = paths / PATH_UNIT / max(len(feature), 1)
            yield pd.Series(np.round(-np.exp2(-mean / scale), SCORE_DECIMALS))

    return score


def verdicts(screen: OrderScreen, scored: DataFrame) -> DataFrame:
    """Two-layer verdict per order: amount screen first, forest review second."""
    screened = screen.outliers().select("order_id", F.lit(True).alias("by_amount"))
    both = scored.select("order_id", "anomaly_score", F.col("is_anomaly").alias("by_forest")).join(
        screened, "order_id", "full"
    )
    by_amount = F.coalesce("by_amount", F.lit(False))
    by_forest = F.coalesce("by_forest", F.lit(False))
    return both.select(
        "order_id",
        "anomaly_score",
        by_amount.alias("by_amount"),
        by_forest.alias("by_forest"),
        F.when(by_amount & by_forest, "both")
        .when(by_amount, "amount only")
        .when(by_forest, "forest only")
        .otherwise("normal")
        .alias("verdict"),
    )
