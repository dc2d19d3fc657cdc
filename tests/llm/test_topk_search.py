import math

import duckdb
import numpy as np
import pytest

from orderlines.llm import topk_search
from orderlines.llm.queries import ORACLE_SQL, QUERIES
from orderlines.llm.topk_search import bounds, inner_products, top_k
from tests.llm.conftest import TABLES

LONG = (1 << 63) - 1


def brute(rows, top=5, every=50):
    usable = [
        (k, [math.floor(256 * x) for x in v])
        for k, v in rows
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for i, (k, q) in enumerate(usable):
        if k % every == 0:
            others = [
                (-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, c)))), o)
                for j, (o, c) in enumerate(usable)
                if j != i and len(c) == len(q)
            ]
            found += [(k, n + 1, o, -s) for n, (s, o) in enumerate(sorted(others)[:top])]
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_small_blocks_and_shards_by_brute_force(vectors, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("SHARD_BLOCKS", 3), ("GROUP_QUERIES", 4)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, (centres[i * 12 // 400] + rng.normal(0, 0.05, 6)).tolist()) for i in range(400)]
    assert rows_of(top_k(vectors(rows), every=9)) == brute(rows, every=9)


def test_ties_nulls_lengths_repeats_and_clashing(vectors):
    from pyspark.sql import functions as F

    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [0.5, 0.1]), (3, [0.5, 0.9]), (5, [0.5, -0.2]), (None, [9.0, 9.0]), (50, None),
        (100, [None, 1.0]), (150, [math.nan, 1.0]), (9, [math.inf, 1.0]), (200, [1.0]), (250, []), (251, []), (8, [-1.0, 2.0]),
    ]
    df = vectors(rows).withColumns({"rank": F.lit("old"), "score": F.lit(1)})
    assert rows_of(top_k(df)) == brute(rows)
    assert top_k(vectors([])).count() == 0


def test_numbers_beyond_exact_floats(vectors):
    big = 2.0**52
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [3.0, 5.0]), (3, [-big, 2.0]), (4, [2.0**40, 0.0]), (50, [2.0**30 + 1, 3.0])]
    assert rows_of(top_k(vectors(rows))) == brute(rows)
    assert inner_products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 1


def test_bounds_hold():
    rng = np.random.default_rng(1)
    queries, block = np.floor(rng.normal(0, 99, (20, 8))), np.floor(rng.normal(3, 50, (30, 8)))
    upper = bounds(queries, block.min(axis=0)[None], block.max(axis=0)[None])[:, 0]
    assert (upper >= (queries @ block.T).max(axis=1)).all()


def test_query_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    expected = connection.execute(ORACLE_SQL["op7_topk_search"]).fetchall()
    assert rows_of(QUERIES["op7_topk_search"](spark, TABLES)) == sorted(expected)
