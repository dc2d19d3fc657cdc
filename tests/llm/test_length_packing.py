import itertools
import random
import re

import numpy as np

from orderlines.llm import length_packing
from orderlines.llm.length_packing import best_boundaries, pack
from orderlines.llm.queries import QUERIES
from tests.llm.conftest import TABLES


def cost(count, lengths, ends):
    return sum(count[i] * (lengths[b - 1] - lengths[i]) for a, b in zip([0, *ends], ends) for i in range(a, b))


def test_boundaries_by_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        n, buckets = rng.randint(1, 7), rng.randint(1, 4)
        lengths = np.array(sorted(rng.sample(range(50), n)), float)
        count = np.array([rng.randint(1, 9) for _ in range(n)], float)
        ends = best_boundaries(count, count * lengths, lengths, buckets)
        best = min(
            cost(count, lengths, [*cut, n])
            for size in range(min(buckets, n))
            for cut in itertools.combinations(range(1, n), size)
        )
        assert cost(count, lengths, ends) == best and len(ends) <= buckets and ends[-1] == n


def check(rows, budget):
    batches = {}
    for r in rows:
        batches.setdefault(r["batch"], []).append(r)
        assert r["padding"] == r["bucket_length"] - r["length"] >= 0
    for members in batches.values():
        width = {r["bucket_length"] for r in members}
        assert len(width) == 1 and (len(members) == 1 or width.pop() * len(members) <= budget)
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return batches


def test_batches_are_full_over_slices(spark, monkeypatch):
    monkeypatch.setattr(length_packing, "SLICE", 50)
    df = spark.range(1000).selectExpr("id AS doc_id", "id % 37 AS n", "'x' AS batch")
    rows = pack(df, "n", buckets=4, budget=200).collect()
    assert len(rows) == 1000
    batches = check(rows, 200)
    short = {}
    for members in batches.values():
        short.setdefault(members[0]["bucket"], []).append(len(members))
    assert len(short) == 4
    for bucket, sizes in short.items():
        assert sorted(sizes)[1:] == [max(sizes)] * (len(sizes) - 1)  # at most one batch is not full
    again = pack(df, "n", buckets=4, budget=200).collect()
    key = lambda r: (r["doc_id"], r["batch"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_null_zero_very_long_repeated_and_empty(spark):
    rows = [(1, None), (2, 0), (3, 100_000), (3, 100_000), (None, 5_000), (4, 4_097)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    found = pack(df, "n", buckets=3).collect()
    assert sorted(r["length"] for r in found) == [0, 0, 4097, 5000, 100000, 100000]
    check(found, length_packing.BUDGET)
    assert pack(df.limit(0), "n").count() == 0


def test_query_packs_every_document_at_least_padding(spark, table):
    rows = QUERIES["op6_length_packing"](spark, TABLES).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in table.collect()}
    assert {r["doc_id"]: r["length"] for r in rows} == words and len(rows) == len(words)
    check(rows, length_packing.BUDGET)
    lengths, count = np.unique([n for n in words.values() if n <= length_packing.EXACT], return_counts=True)
    assert len(lengths) == len(set(words.values()))  # so the histogram was exact
    best = np.where(np.arange(len(lengths) + 1) == 0, 0.0, np.inf)
    for _ in range(length_packing.BUCKETS):
        best = np.array([0.0] + [min(best[a] + cost(count[a:b], lengths[a:b], [b - a]) for a in range(b)) for b in range(1, len(best))])
    assert sum(r["padding"] for r in rows) == best[-1]
