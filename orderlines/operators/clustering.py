"""K-means on recency, frequency and spend, to check the rule-based segments.

Lloyd rounds run over the histogram of the standardized features in whole millionths: equal customers are one weighted
point, sums are whole numbers, and a round gives the same centres however the rows lie. All
fits (each number of clusters, each start) advance in the same pass: a task sums its points per fit and cluster,
those sums merge in the shuffle, and the driver sees one row per fit and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlines.functions.order_statistics import column_quantiles
from orderlines.functions.storage import materialize

FEATURES = ["recency", "frequency", "monetary"]
GRID = [f"g_{name}" for name in FEATURES]
SEED = 42
RESTARTS = 10
#: Whole units of a standard deviation.
UNIT = 1_000_000
#: Rounds at most. A fit is at rest earlier, when the squared moves of its centres add up to TOLERANCE variances or less.
ROUNDS = 50
TOLERANCE = 1e-4

_SUMS = ["sum_r", "sum_f", "sum_m", "weight"]

#: Centres by number of clusters and start.
Fits = dict[tuple[int, int], list[list[float]]]


def feature_moments(customers: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature, one row per feature."""
    return (
        customers.where(F.col("recency").isNotNull())
        .select(*[F.col(c).cast("double").alias(c) for c in FEATURES])
        .unpivot([], FEATURES, "feature", "value")
        .groupBy("feature")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        )
    )


def standardize(customers: DataFrame) -> DataFrame:
    """``z_`` columns with mean 0 and population deviation 1; a constant feature becomes 0."""
    moments = {row["feature"]: row for row in feature_moments(customers).collect()}
    columns = {}
    for name in FEATURES:
        # No customers, no moments.
        mean, std = (moments[name]["mean"], moments[name]["std"]) if name in moments else (0.0, 1.0)
        columns[f"z_{name}"] = (F.col(name).cast("double") - mean) / (std if std and std > 0 else 1.0)
    return customers.where(F.col("recency").isNotNull()).withColumns(columns)


@dataclass(frozen=True)
class Clustering:
    customers: DataFrame
    centers: DataFrame
    inertia: float


def _grid_columns() -> dict[str, Column]:
    """The standardized features in whole units."""
    return {f"g_{name}": F.round(F.col(f"z_{name}") * UNIT).cast("long") for name in FEATURES}


def feature_grid(standardized: DataFrame) -> DataFrame:
    """The distinct points ``g_*`` with their customers ``n``."""
    return standardized.withColumns(_grid_columns()).groupBy(*GRID).agg(F.count(F.lit(1)).alias("n"))


def _starts(points: DataFrame, most: int, restarts: int) -> list[list[list[float]]]:
    """Per start ``most`` distinct points (all, if fewer), those with the least hash of start and point."""
    drawn = None
    for start in range(restarts):
        place = F.md5(F.concat_ws(":", F.lit(SEED), F.lit(start), *[F.col(c).cast("string") for c in GRID]).cast("binary"))
        first = points.select(F.lit(start).alias("start"), place.alias("place"), *GRID).orderBy("place").limit(most)
        drawn = first if drawn is None else drawn.unionByName(first)
    rows = sorted(drawn.collect(), key=lambda row: (row["start"], row["place"]))
    return [[[float(row[c]) for c in GRID] for row in rows if row["start"] == start] for start in range(restarts)]


def _closest(places: list[np.ndarray], centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre per point, of equal ones the first, and the squared distance: a centre at a time."""
    cluster = np.zeros(len(places[0]), np.int64)
    least = np.full(len(places[0]), np.inf)
    for number, at in enumerate(centre):
        r, f, m = (place - x for place, x in zip(places, at))
        far = r * r + f * f + m * m
        cluster[far < least] = number
        np.minimum(least, far, out=least)
    return cluster, least


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles, where none of their sums can reach 2 ** 53, else as they are."""
    doubles = values.astype(np.float64)
    return doubles if np.abs(doubles).sum() < 2.0**52 else values


def _sums(cluster: np.ndarray, values: np.ndarray, clusters: int) -> np.ndarray:
    """Exact sums per cluster of what ``_exact`` returns."""
    if values.dtype == np.float64:
        return np.bincount(cluster, values, clusters).astype(np.int64)
    return np.array([values[cluster == number].sum() for number in range(clusters)], np.int64)


def _advance(points: DataFrame, fits: Fits) -> tuple[Fits, dict[tuple[int, int], float]]:
    """All fits after one round, and what their centres cost before it."""
    keys = list(fits)
    centres = [np.array(fits[key]) for key in keys]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), 4), np.int64) for c in centres]
        costs = [np.zeros(len(c)) for c in centres]
        for batch in batches:
            grid = [batch.column(i).to_numpy() for i in range(3)]
            weight = batch.column(3).to_numpy()
            weighted = [_exact(values) for values in (*[g * weight for g in grid], weight)]
            places = [g.astype(np.float64) for g in grid]
            for fit, centre in enumerate(centres):
                cluster, far = _closest(places, centre)
                costs[fit] += np.bincount(cluster, far * weight, len(centre))
                sums[fit] += np.column_stack([_sums(cluster, values, len(centre)) for values in weighted])
        rows = [
            (fit, number, *map(int, sums[fit][number]), float(costs[fit][number]))
            for fit in range(len(centres))
            for number in range(len(centres[fit]))
            if sums[fit][number][3]
        ]
        names = ["fit", "number", *_SUMS, "cost"]
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.float64()]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "fit int, number int, " + ", ".join(f"{c} long" for c in _SUMS) + ", cost double"
    merged = (
        points.select(*GRID, "n")
        .mapInArrow(add, schema)
        .groupBy("fit", "number")
        .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _SUMS], F.sum("cost").alias("cost"))
        .collect()
    )
    moved = {key: [list(c) for c in fits[key]] for key in keys}
    costs = dict.fromkeys(keys, 0.0)
    for row in merged:
        key = keys[row["fit"]]
        moved[key][row["number"]] = [float(int(row[c])) / float(int(row["weight"])) for c in _SUMS[:3]]
        costs[key] += row["cost"]
    return moved, {key: cost / UNIT**2 for key, cost in costs.items()}


def _shift(before: list[list[float]], after: list[list[float]]) -> float:
    return sum((x - y) * (x - y) for old, new in zip(before, after) for x, y in zip(old, new))


def best_fits(points: DataFrame, ks: list[int], restarts: int) -> dict[int, tuple[list[list[float]], float]]:
    """For each number of clusters the cheapest of its starts: centres in order, and inertia.

    Of starts that cost the same to six places the first one counts.
    """
    starts = _starts(points, max(ks), restarts)
    fits: Fits = {(k, n): start[:k] for k in ks for n, start in enumerate(starts) if start}
    moving = fits
    for _ in range(ROUNDS):
        moved, _ = _advance(points, moving)
        fits = {**fits, **moved}
        moving = {key: moved[key] for key in moving if _shift(moving[key], moved[key]) > TOLERANCE * UNIT**2}
        if not moving:
            break
    costs = _advance(points, fits)[1] if fits else {}
    best = {}
    for k in ks:
        ranked = sorted((round(costs[key], 6), key[1]) for key in fits if key[0] == k)
        if ranked:
            best[k] = sorted(fits[k, ranked[0][1]]), ranked[0][0]
    return best


def _nearest(centres: list[list[float]]) -> Column:
    """Number of the nearest centre, of equal ones the first."""
    def far(centre: list[float]) -> Column:
        r, f, m = (F.col(name) - F.lit(c) for name, c in zip(GRID, centre))
        return r * r + f * f + m * m

    distances = F.array(*[far(c) for c in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def cluster_customers(customers: DataFrame, k: int = 4, restarts: int = RESTARTS) -> Clustering:
    """Clusters from the best of several starts, numbered by their centres, and a row per cluster in original units."""
    points = materialize(
        standardize(customers).withColumns(_grid_columns()).select("customer_id", *FEATURES, *GRID), "standardized"
    )
    grid = materialize(points.groupBy(*GRID).agg(F.count(F.lit(1)).alias("n")), "grid")
    found = best_fits(grid, [k], restarts)
    centres, inertia = found.get(k, ([], 0.0))
    label = _nearest(centres) if centres else F.lit(None).cast("int")
    labelled = materialize(points.select("customer_id", *FEATURES, label.alias("cluster")), "clusters")
    medians = column_quantiles(labelled, {c: [0.5] for c in FEATURES})
    centers = labelled.groupBy("cluster").agg(
        *[F.round(F.avg(F.col(c).cast("double")), 1).alias(c) for c in FEATURES],
        F.count(F.lit(1)).alias("count"),
    )

    def compared(column: str, better: str, other: str):
        middle = F.lit(medians[column][0])
        test = F.col(column) < middle if column == "recency" else F.col(column) > middle
        return F.when(test, better).otherwise(other)

    # The texts of a profile.
    profile = F.concat(
        F.lit("聚类"), (F.col("cluster") + 1).cast("string"),
        F.lit(": R"), compared("recency", "近", "远"),
        F.lit("/F"), compared("frequency", "高", "低"),
        F.lit("/M"), compared("monetary", "高", "低"),
    )
    centers = centers.withColumn("profile", profile).orderBy("cluster")
    return Clustering(labelled, centers, round(inertia, 2))


def elbow(customers: DataFrame, max_k: int = 8, restarts: int = RESTARTS) -> DataFrame:
    """Sum of squared distances for 1 to ``max_k`` clusters; all fits share the passes over the data."""
    grid = materialize(feature_grid(standardize(customers)), "grid")
    found = best_fits(grid, list(range(1, max_k + 1)), restarts)
    costs = [(k, round(inertia, 2)) for k, (_, inertia) in found.items()]
    return customers.sparkSession.createDataFrame(costs, "k int, inertia double")
