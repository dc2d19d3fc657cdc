import re

import numpy as np
import pytest
import xxhash

from orderlines.llm import simhash
from orderlines.llm.components import connected_components
from orderlines.llm.queries import QUERIES
from tests.llm.conftest import TABLES


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(size, edges):
    parent = list(range(size))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(size)]


def brute_groups(rows):
    """component_id per row, all pairs compared."""
    prints = [brute_print(text) for _, text in rows]
    distinct = sorted(set(prints))
    values = np.array(distinct, np.uint64)
    edges = [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= 4).tolist()]
    root = dict(zip(distinct, roots(len(distinct), edges)))
    least = {}
    for (key, _), value in zip(rows, prints):
        if key is not None:
            least[root[value]] = min(least.get(root[value], key), key)
    return [(f"{value:016x}", least.get(root[value])) for value in prints]


@pytest.mark.parametrize("limit", [200, 4_000_000])
def test_links_of_all_buckets_connect_what_is_near(monkeypatch, limit):
    monkeypatch.setattr(simhash, "PASS_VARIANTS", limit)
    rng = np.random.default_rng(0)
    values = set()
    for base in rng.integers(0, 2**63, 20, dtype=np.uint64).tolist():
        for _ in range(6):
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                base ^= 1 << bit
            values.add(base)
    values = np.array(sorted(values), np.uint64)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    wanted = roots(len(values), zip(*np.nonzero(apart <= 4)))
    place = {int(v): i for i, v in enumerate(values)}
    links = []
    for bucket in range(1 << simhash.BUCKET_BITS):
        a, b = simhash.links_in_bucket(values.copy(), bucket, simhash.BUCKET_BITS, 2)
        links += [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]
    assert roots(len(values), links) == wanted


def test_more_buckets_than_the_least_number(monkeypatch, documents):
    monkeypatch.setattr(simhash, "BUCKET_FINGERPRINTS", 4)
    rows = [(i, f"some words that make a text {i % 9} of its own kind {i % 9}") for i in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(rows)).collect()}
    assert [found[i] for i, _ in rows] == [c for _, c in brute_groups(rows)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert set(found) == {*range(61), *range(100, 130), 200, 201}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(100, 130)}) == 1
    assert len(set(found.values())) == 3
    assert connected_components(df.where("a = 7 AND b = 7")).count() == 0


def test_null_empty_repeated_long_and_clashing(documents):
    rows = [(5, None), (4, ""), (9, " \n"), (None, "a b c d e"), (3, "A b C d e"), (3, "A b C d e"), (2, "x y " * 20000), (None, "lonely text")]
    df = documents(rows, fingerprint="old")
    grouped = simhash.near_duplicates(df, keep=("doc_id", "text", "fingerprint"))
    found = sorted(((r["doc_id"], r["text"] or ""), r["fingerprint"], r["component_id"]) for r in grouped.collect() if r["doc_id"])
    wanted = sorted(((k, t or ""), *g) for (k, t), g in zip(rows, brute_groups(rows)) if k)
    assert found == wanted
    kept = simhash.keep_first(grouped).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 2, 3, 4]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_odd_radius_is_refused(documents):
    with pytest.raises(ValueError):
        simhash.near_duplicates(documents([(1, "a")]), radius=3)


def test_query_by_brute_force(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, TABLES).collect()}
    assert [found[k] for k, _ in rows] == brute_groups(rows)
