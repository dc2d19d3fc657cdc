import random
import re
from collections import Counter

from orderlines.llm.quality_rules import _examine, covered, keep_good, quality_rules, repeat_lengths
from orderlines.llm.queries import QUERIES
from tests.llm.conftest import TABLES


def brute(text):
    """The contract's counts, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside),
        len(words) < 20 or 100 * len(inside) > 30 * len(words),
    )


def brute_kept(text):
    """The verdict from all pairs of positions: share of bytes in repeats of 8 words or more, and the longest repeat."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    repeats, inside = 0, set()
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            repeats = max(repeats, k)
            if k >= 8:
                inside |= set(range(i, i + k)) | set(range(j, j + k))
    size = lambda at: sum(len(words[n].encode()) for n in at)
    share = size(inside) / max(size(range(len(words))), 1)
    return not brute(text)[5] and share <= 0.25 and repeats <= 50


def rows_of(df):
    return [
        (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df
    ]


def test_longest_repeats_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.choice("ab c") for _ in range(rng.randint(0, 40))]
        text = "".join(w + " " for w in words if w.strip()).encode()
        split = text.split()
        best = 0
        for i in range(len(split)):
            for j in range(i):
                k = 0
                while i + k < len(split) and split[i + k] == split[j + k]:
                    k += 1
                best = max(best, k)
        assert _examine([text])[7][0] == best


def test_no_repeat_crosses_documents():
    text = " ".join(f"w{i}" for i in range(60)).encode()
    assert list(_examine([text, text, b"", text])[4]) == [0, 0, 0, 0]


def test_spans_and_limits():
    passage = " ".join(f"p{i}" for i in range(30))
    fillers = [" ".join(f"{k}f{i}" for i in range(200)) for k in range(3)]
    text = f"{fillers[0]} {passage} {fillers[1]} {passage} {fillers[2]}"
    result = _examine([text.encode()])
    assert result[9][0] == [{"start": 200, "stop": 230}, {"start": 430, "stop": 460}]
    assert result[7][0] == 30 and result[6][0]
    long = " ".join(f"p{i}" for i in range(250))
    apart = " ".join(f"f{i}" for i in range(3000))
    assert not _examine([f"{long} {apart} {long}".encode()])[6][0]


def test_verdict_by_brute_force(documents):
    rng = random.Random(4)
    fresh = iter(range(10**6))
    texts = []
    for size, length in [(60, 9), (60, 12), (120, 8), (120, 14), (200, 45), (200, 52), (300, 30), (300, 49), (500, 51), (500, 60), (40, 0)] * 3:
        words = [f"w{next(fresh)}" for _ in range(size)]
        passage = [f"{'long' * rng.randrange(3)}p{next(fresh)}" for _ in range(length)]
        cut = rng.randrange(size)
        texts.append(" ".join(passage + words[:cut] + passage + words[cut:]))
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(documents(list(enumerate(texts)))).collect()}
    assert found == {i: (brute(t)[5], brute_kept(t)) for i, t in enumerate(texts)}
    assert sum(not failed and not kept for failed, kept in found.values()) > 3


def test_null_empty_long_repeated_and_clashing(documents):
    texts = [None, "", "a b", "x " * 30000, "x " * 30000, "\n \n", "é日 " + " ".join(f"w{i}" for i in range(30))]
    df = quality_rules(documents(list(enumerate(texts)), kept="old"), keep=("doc_id", "kept"))
    found = sorted(df.collect(), key=lambda r: r["doc_id"])
    assert rows_of(found) == [brute(t) for t in texts]
    assert [r["kept"] for r in found] == [False] * 6 + [True]
    assert quality_rules(documents([])).count() == 0
    assert keep_good(documents(list(enumerate(texts)))).columns == documents([]).columns


def test_query_by_brute_force(spark, table):
    rows = sorted(QUERIES["op3_quality_rules"](spark, TABLES).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] for r in sorted(table.collect(), key=lambda r: r["doc_id"])]
    assert rows_of(rows) == [brute(t) for t in texts]
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_helpers_of_few_words():
    import numpy as np

    assert repeat_lengths(np.array([5]), np.array([1])).tolist() == [0]
    assert covered(np.array([3, 0, 0, 0]), 2).tolist() == [True, True, True, False]
