import random
from collections import defaultdict

import numpy as np
import pytest

from orderlines.llm import shingle_join
from orderlines.llm.shingle_join import cheapest_boundary, prefix_length, shingle_components


def shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows):
    """Every pair of different sets is compared."""
    sets = [(k, shingles(t)) for k, t in rows]
    distinct = sorted({s for _, s in sets if s}, key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            shared = len(a & b)
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, s in sets:
        if s and k is not None:
            r = find(s)
            least[r] = k if least[r] is None else min(k, least[r])
    return sorted(((k, len(s), least[find(s)] if s else k) for k, s in sets), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def words(random_, n, vocabulary=4000):
    return [f"w{random_.randrange(vocabulary)}" for _ in range(n)]


def edited(random_, text, edits):
    text = list(text)
    for _ in range(edits):
        text[random_.randrange(len(text))] = f"e{random_.randrange(10**6)}"
    return text


@pytest.fixture
def corpus():
    """Texts of all sizes, copies with more and more edits, and passages that many share."""
    random_ = random.Random(7)
    texts = []
    for n in (1, 2, 4, 5, 6, 8, 9, 10, 13, 20, 40, 90, 200):
        for _ in range(3):
            base = words(random_, n)
            texts += [base, base + words(random_, 1), base[1:] or base, edited(random_, base, 1), edited(random_, base, 2)]
    passage = words(random_, 60)
    texts += [words(random_, 25) + passage + words(random_, 5) for _ in range(25)]
    base = words(random_, 120)
    texts += [edited(random_, base, random_.randrange(7)) for _ in range(40)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("common, rounds, limit", [(8, 3, 256), (2, 1, 1), (10**6, 0, 256)])
def test_components_by_brute_force(documents, corpus, monkeypatch, common, rounds, limit):
    """Whatever the order, the number of leader rounds and the boundary, the components are the same."""
    monkeypatch.setattr(shingle_join, "COMMON", common)
    monkeypatch.setattr(shingle_join, "ROUNDS", rounds)
    monkeypatch.setattr(shingle_join, "SMALL_LIMIT", limit)
    monkeypatch.setattr(shingle_join, "CHUNK_SHINGLES", 2000)
    assert rows_of(shingle_components(documents(corpus))) == brute(corpus)


@pytest.mark.parametrize("boundary", [0, 30])
def test_any_boundary_gives_the_same(documents, corpus, monkeypatch, boundary):
    monkeypatch.setattr(shingle_join, "cheapest_boundary", lambda counts, similarity: boundary)
    small = [row for row in corpus if len(row[1].split()) < 50]
    assert rows_of(shingle_components(documents(small))) == brute(small)


def test_boundary_follows_the_cost(spark):
    def counts(scan):
        rows = [(1, n, 100, 0) for n in range(1, 60)] + [(2, 0, 1000, int(1000 * scan))]
        return spark.createDataFrame(rows, shingle_join.COUNTS)

    crowded, sparse = (cheapest_boundary(counts(scan), (80, 100)) for scan in (50.0, 1.0))
    assert crowded > sparse


def test_prefix_holds_the_shared_ones():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(100, n, replace=False).tolist())
        b = (a - set(list(a)[: int(rng.integers(0, 5))])) | set(rng.choice(200, int(rng.integers(0, 5))).tolist())
        if b and 100 * len(a & b) >= 80 * len(a | b):
            for c in range(1, min(3, len(a & b)) + 1):
                x, y = (set(sorted(s)[: prefix_length(len(s), c, (80, 100))]) for s in (a, b))
                assert len(x & y) >= c


def test_nulls_empty_blank_repeats_and_long_texts(documents):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (None, "a b"), (6, "c"), (6, "c"), (7, long), (8, long + " end"), (9, long[: len(long) // 2])]
    df = documents(rows, set_id="x", n_shingles="x", component_id="x", listed="x", text_hash="x", label="x")
    assert rows_of(shingle_components(df)) == brute(rows)


def test_empty_table(documents):
    assert rows_of(shingle_components(documents([]))) == []


def test_hot_group_just_below_the_similarity(documents):
    """Copies that share four fifths of their words at most: no list of them becomes all its pairs."""
    random_ = random.Random(11)
    base = words(random_, 100)
    rows = [(i, " ".join(edited(random_, base, 4))) for i in range(150)]
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    assert rows_of(shingle_components(documents(rows))) == brute(rows)
