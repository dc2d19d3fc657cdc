import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderlines.llm import lm_scoring
from orderlines.llm.lm_scoring import FREQUENCY_BUCKETS, ROUNDS, SETTLED, score_texts
from orderlines.llm.queries import QUERIES
from orderlines.llm.texts import BATCH_SETTING, SENT_BYTES
from tests.llm.conftest import TABLES


def brute(rows):
    """Counts, expectation-maximisation and scores with dictionaries."""
    end, start = object(), object()
    texts = []
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        part = zlib.crc32(("" if key is None else str(key)).encode()) % 5
        texts.append((part, re.findall(r"[^\x20\x09-\x0D]+", low) + [end]))

    def count(parts):
        word, pair = Counter(), Counter()
        for part, tokens in texts:
            if part in parts:
                word.update(tokens)
                pair.update(zip([start, *tokens], tokens))
        return word, pair, sum(word.values()), {**word, start: word[end]}

    def parts_of(tokens, counts):
        word, pair, total, context = counts
        for h, w in zip([start, *tokens], tokens):
            c = context.get(h, 0)
            bucket = 0 if not c else min(1 + int(math.log2(c)), FREQUENCY_BUCKETS - 1)
            yield bucket, pair.get((h, w), 0) / max(c, 1), word.get(w, 0) / max(total, 1)

    others = count({2, 3, 4})
    weights = np.tile([0.4, 0.4, 0.2], (FREQUENCY_BUCKETS, 1))
    weights[0] = [0, 0.7, 0.3]
    uniform = 1 / (len(others[0]) + 1)
    held = [p for part, tokens in texts if part == 0 for p in parts_of(tokens, others)]
    for _ in range(ROUNDS):
        sums = np.full((FREQUENCY_BUCKETS, 3), 0.5)
        for bucket, two, one in held:
            shares = weights[bucket] * np.array([two, one, uniform])
            sums[bucket] += shares / shares.sum()
        sums[0, 0] = 0  # as many as none: the half that others get is left out
        new = sums / sums.sum(axis=1, keepdims=True)
        if not held:
            new = weights
        settled = np.abs(new - weights).max() < SETTLED
        weights = new
        if settled:
            break
    everything = count({0, 2, 3, 4})
    word, _, total, _ = everything
    result = []
    for part, tokens in texts:
        base = sum(math.log10((word.get(w, 0) + 0.5) / (total + 0.5 * (len(word) + 1))) for w in tokens)
        model = sum(math.log10(weights[b] @ [two, one, 1 / (len(word) + 1)]) for b, two, one in parts_of(tokens, everything))
        result.append((part == 1, len(tokens), sum(w in word for w in tokens), total, base, model))
    return result


def compare(found, rows):
    wanted = brute(rows)
    made = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]), tuple(r)[-6:]) for r in found)
    expected = sorted(((k is None, k or 0, w[1]), w) for (k, _), w in zip(rows, wanted))
    assert [m[0] for m in made] == [e[0] for e in expected]
    for (_, m), (_, e) in zip(made, expected):
        assert m[:4] == e[:4] and m[4:] == pytest.approx(e[4:], rel=1e-9)


@pytest.mark.parametrize("chunk,bucket", [(8 << 20, 2_000_000), (400, 60)])
def test_by_brute_force(documents, monkeypatch, chunk, bucket):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", bucket)
    words = "the a of cat dog sat on Mat é and".split()
    rows = [(i, " ".join(words[(i * k + k * k) % 10] for k in range(i % 23))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "the cat"), (3, "the cat again"), (203, "cat " * 3000)]
    compare(score_texts(documents(rows, score="old"), keep=("doc_id", "score")).collect(), rows)


def test_empty_and_untrained(documents):
    assert score_texts(documents([])).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    found = score_texts(documents([(i, "a b") for i in held])).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(0, 0, 0.0)] * 3
    assert all(math.isfinite(r["score"]) for r in found)


def test_query_by_brute_force_and_better_than_base(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    found = QUERIES["op10_lm_scoring"](spark, TABLES).collect()
    compare(found, rows)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_batches_to_python_are_bounded_by_bytes(spark, documents):
    """Chunks of some MB: by Spark's default, a batch of 64 MB holds many of them."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, "64MB")
    try:
        assert score_texts(documents([(1, "a b"), (2, "b c")])).count() == 2
        assert int(spark.conf.get(BATCH_SETTING)) <= SENT_BYTES
    finally:
        spark.conf.set(BATCH_SETTING, before)
