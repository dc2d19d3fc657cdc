import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderlines.llm import source_mix
from orderlines.llm.queries import QUERIES
from orderlines.llm.source_mix import mix_sources, source_targets, split_quotas, take
from tests.llm.conftest import TABLES


def brute_targets(sizes, cap=3):
    """Shares by weight; what is above the cap is shared anew until none is."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > cap * sizes[n]}
        if not full:
            target |= {n: weight[n] * level for n in open_}
            break
        target |= {n: cap * sizes[n] for n in full}
        left -= sum(cap * sizes[n] for n in full)
        open_ -= full
    return target


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 10}, {"a": 1, "b": 100, "c": 100, None: 7}, {"é": 0, "z": 5, "Z": 900, "b": 3, "c": 2, "d": 40}, {"x": 0}]
)
def test_targets_by_brute_force(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_tree_splits_exactly_and_by_the_hypergeometric_law(spark):
    counts = [1000, 0, 37, 5, 200]
    rows = split_quotas(spark.createDataFrame([(counts,)], "counts array<long>"), 4).collect()
    assert sorted(r["shard"] for r in rows) == list(range(16))
    assert [sum(r["counts"][i] for r in rows) for i in range(5)] == counts
    sizes = [sum(r["counts"]) for r in rows]
    assert max(sizes) - min(sizes) <= 1 and all(min(r["counts"]) >= 0 for r in rows)
    # Draws of 20 of 40 units, 10 of them marked: mean 5, variance 20 * 1/4 * 3/4 * 20/39.
    draws = spark.range(3000).select(
        source_mix._hypergeometric(F.lit(40), F.lit(10), F.lit(20), source_mix._uniform(F.col("id"))).alias("x")
    )
    mean, variance = draws.agg(F.avg("x"), F.variance("x")).first()
    assert abs(mean - 5) < 0.1 and abs(variance - 1.923) < 0.2


def check(rows):
    """Targets by brute force, copies within the cap, and each source near its target."""
    sizes, taken, most = defaultdict(int), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert len(r["shards"]) == r["copies"] <= 3
    targets = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= most[source]
        assert taken[source] <= target + 1e-6


@pytest.mark.parametrize("block", [8, 4096])
def test_hot_null_empty_repeated_and_clashing(documents, monkeypatch, block):
    monkeypatch.setattr(source_mix, "BLOCK_DOCUMENTS", block)
    rows = [(i, "word " * (1 + i % 9), "hot") for i in range(200)]
    rows += [(1000 + i, f"few {i} words", "small") for i in range(5)] + [(None, "no key at all", None), (None, None, None)]
    rows += [(2000, "x " * 3000, "long"), (2001, "", "blank"), (2002, None, "blank"), (5, "the same row", "twice"), (5, "the same row", "twice")]
    df = documents(rows, copies="old", target="old")
    found = mix_sources(df).collect()
    assert len(found) == len(rows)
    check(found)
    again = mix_sources(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["copies"], sorted(r["shards"]))
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mix_sources(documents([])).count() == 0


def test_the_mix_has_every_copy(documents, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK_DOCUMENTS", 2)
    df = mix_sources(documents([(i, "a b c", "ab"[i % 2]) for i in range(50)]))
    copies = {r["doc_id"]: r["copies"] for r in df.collect()}
    mix = take(df).collect()
    assert Counter(r["doc_id"] for r in mix) == Counter({k: n for k, n in copies.items() if n})
    assert len({r["shard"] for r in mix}) > 10


def test_query(spark, table):
    rows = QUERIES["op8_source_mix"](spark, TABLES).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in table.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    assert all(r["taken"] == r["size"] * r["copies"] for r in rows)
    check(rows)


def test_main_path_is_native(spark):
    plan = QUERIES["op8_source_mix"](spark, TABLES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
