import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlines.llm.hadamard_clusters import SIZE, cluster_vectors, nearest, restore, transform
from orderlines.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import TABLES

LONG = (1 << 63) - 1


def brute(rows, count=8, rounds=10, seed=3):
    """The rules in plain integers, without a transform."""
    def whole(x):
        return int(x) * 1024 if abs(x) >= 1 << 53 else math.floor(1024 * x)

    kept = [
        (k, [whole(float(x)) for x in v])
        for k, v in rows
        if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest(), v) for k, v in kept)
    centroids = [v for _, v in named[:count]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        labels = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, labels) if c == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine)]
    labels = assign()
    total = sum(d for _, d in labels)
    fit = lambda x: x if x <= LONG else None
    result = []
    for (k, _), (c, d) in zip(kept, labels):
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        result.append((k, c, fit(d), fit(sum(x for m, x in labels if m == c)), fit(total), digest))
    return sorted(result, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_transform_keeps_distances_and_comes_back():
    values = np.random.default_rng(1).integers(-(1 << 19), 1 << 19, (40, SIZE))
    moved = transform(values)
    assert (restore(moved) == values).all()
    assert ((moved[0] - moved[1]) ** 2).sum() == SIZE * ((values[0] - values[1]) ** 2).sum()
    assert (np.diff((np.diff(transform(np.eye(SIZE, dtype=np.int64)).T, axis=1) != 0).sum(axis=1)) >= 0).all()


def test_progressive_search_finds_the_least_and_the_smaller_number():
    rng = np.random.default_rng(2)
    points, centroids = rng.integers(-3, 4, (500, SIZE)), rng.integers(-3, 4, (9, SIZE))
    centroids[7] = centroids[2]
    far = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance = nearest(transform(points), transform(centroids))
    assert (cluster == far.argmin(axis=1)).all()
    assert (distance // SIZE == far.min(axis=1)).all()


def test_clusters_by_brute_force(vectors):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, SIZE))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.4, SIZE)).tolist()) for i in range(160)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    assert rows_of(cluster_vectors(vectors(rows))) == brute(rows)


def test_unusable_vectors_and_huge_components(vectors):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(0, 1, SIZE).tolist()) for i in range(20)]
    bad = [(20, None), (21, [0.0] * 63), (22, [0.0] * 63 + [None]), (23, [0.0] * 63 + [float("nan")]), (24, [float("inf")] + [0.0] * 63)]
    assert rows_of(cluster_vectors(vectors(good + bad))) == brute(good + bad)
    huge = good + [(30, [1.7e308] + [0.0] * 63), (31, [-3e9] * SIZE), (32, [5e-324] * SIZE), (33, [1023.9999] * SIZE)]
    assert rows_of(cluster_vectors(vectors(huge))) == brute(huge)


def test_few_equal_and_no_vectors(vectors):
    for rows in ([], [(1, [0.5] * SIZE)], [(i, [0.25] * SIZE) for i in range(12)]):
        assert rows_of(cluster_vectors(vectors(rows))) == brute(rows)


def test_extra_columns_with_clashing_names(vectors):
    rows = [(i, np.random.default_rng(i).normal(0, 1, SIZE).tolist()) for i in range(15)]
    clashing = vectors(rows).withColumns({n: F.lit("x") for n in ("key", "vector", "cluster", "coefficients", "narrow", "inertia")})
    assert rows_of(cluster_vectors(clashing)) == brute(rows)


def test_query_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    result = connection.execute(ORACLE_SQL["op11_hadamard_clusters"])
    names = [column[0] for column in result.description]
    df = QUERIES["op11_hadamard_clusters"](spark, TABLES)
    assert rows_of(df.select(*names)) == sorted(result.fetchall(), key=repr)
