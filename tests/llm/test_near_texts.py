import random
from itertools import combinations

import corpus_pipeline
from orderlines.llm.near_texts import near_links
from orderlines.llm.simhash import fingerprint
from tests.llm.conftest import TABLES


def shingles(text):
    words = text.lower().split()
    size = min(5, len(words))
    return {b" ".join(words[at : at + size]) for at in range(len(words) - size + 1)} if words else set()


def jaccard(first, second):
    return len(first & second) / len(first | second) if first & second else 0.0


def signed(text):
    value = fingerprint((text or "").encode())
    return value - (1 << 64) if value >> 63 else value


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def copies(rng, groups):
    texts = []
    for group in range(groups):
        words = [f"g{group}w{rng.randrange(400)}" for _ in range(120)]
        texts += [" ".join(words)] + [edited(rng, words, rng.choice([1, 2, 3, 8])) for _ in range(4)]
    return texts


def joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def same_groups(left, right):
    parts = lambda root: {frozenset(k for k in root if root[k] == r) for r in root.values()}
    return {p for p in parts(left) if len(p) > 1} == {p for p in parts(right) if len(p) > 1}


def test_links_connect_all_pairs_of_the_similarity(documents):
    rng = random.Random(1)
    texts = [*copies(rng, 12), None, "", " \n", "one two", "ONE  two", "one two three"]
    pairs = [(x, y) for x, y in combinations(texts, 2) if jaccard(shingles((x or "").encode()), shingles((y or "").encode())) >= 0.8]
    found = near_links(documents(list(enumerate(texts)) + [(7, texts[7])])).collect()
    wanted = {(signed(x), signed(y)) for x, y in pairs}
    assert len(wanted) > 30 and {(r["a"], r["b"]) for r in found} <= wanted | {(b, a) for a, b in wanted}
    assert same_groups(joined((r["a"], r["b"]) for r in found), joined(wanted))


def test_hot_group_around_the_similarity(documents):
    """Copies of one text with more and more edits: near ones meet through others, the rest stay apart."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = [edited(rng, words, edits) for edits in range(12) for _ in range(8)]
    found = near_links(documents(list(enumerate(texts)))).collect()
    pairs = [(x, y) for x, y in combinations(texts, 2) if jaccard(shingles(x.encode()), shingles(y.encode())) >= 0.8]
    assert len(found) < len(pairs)
    assert same_groups(joined((r["a"], r["b"]) for r in found), joined((signed(x), signed(y)) for x, y in pairs))


def test_stage_keeps_one_of_near_copies_that_fingerprints_tell_apart(spark, documents):
    rng = random.Random(3)
    rows = []
    while len(rows) < 20:
        words = [f"t{len(rows)}w{rng.randrange(400)}" for _ in range(100)]
        first, second = " ".join(words), edited(rng, words, 1)
        if (fingerprint(first.encode()) ^ fingerprint(second.encode())).bit_count() > 4:
            rows += [(len(rows), first), (len(rows) + 1, second)]
    kept = corpus_pipeline.simhash_stage(spark, documents(rows), TABLES)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in rows if i % 2 == 0]


def test_very_long_texts(documents):
    long = [f"l{i}" for i in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-100])), (3, " ".join(long[:20_000]))]
    found = near_links(documents(rows)).collect()
    assert {frozenset((r["a"], r["b"])) for r in found} == {frozenset((signed(rows[0][1]), signed(rows[1][1])))}


def test_empty_table(documents):
    assert near_links(documents([])).count() == 0
