import random

import pytest
from tokenizers import Tokenizer

from orderlines.llm.queries import QUERIES
from orderlines.llm.token_counts import (
    PrefixCounter, default_vocabulary, longest_prefix, prefix_token_counts, tokens_within,
)
from tests.llm.conftest import TABLES

TEXTS = [
    "don't you'Re 'll 're", "aaaaaaaa'", "<|startoftext|> a <|endoftext|><|endo", "x!!<|startoftext|>ab",
    "İstanbul ΑΣ σας", "日本語 text é è 12345 ½ Ⅷ ²", "", "   ", "\t\na", "𝒳𝒴 😀😀 ﷺ", "a\x1cb\x85c d",
    "<|startoftext|><|startoftext|>", "w" * 300, "ﬁé́x",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(default_vocabulary())


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_as_the_library_counts_it(counter, library, text):
    counts = counter.counts(text)
    assert (counts[-1] if len(counts) else 0) == library(text)
    normal = counter.normalize(text)
    if len(normal) == len(text) == len(counts):
        assert counts.tolist() == [library(text[: i + 1]) for i in range(len(text))]


def test_random_prefixes(counter, library):
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("aabcdeinthes'é!.,1 ") for _ in range(rng.randint(1, 40)))
        assert counter.counts(text).tolist() == [library(text[: i + 1]) for i in range(len(text))]


def test_shared_prefix_states_equal_those_of_a_word_alone(counter):
    for word in ("international", "internationally", "überraschungsgast"):
        assert counter.word(word) == counter._long_word(word)


def test_null_empty_long_repeated_and_clashing_columns(spark, documents, library):
    rows = [(1, None), (2, ""), (3, "the cat " * 5000), (3, "the cat " * 5000), (None, "a cat"), (4, "x" * 5000)]
    df = prefix_token_counts(documents(rows, n_tokens="old"), keep=("doc_id", "lang", "n_tokens"))
    found = {(r["doc_id"], r["n_bytes"]): r for r in df.collect()}
    assert df.count() == 6 and df.columns[:2] == ["doc_id", "lang"]
    assert [found[k]["n_tokens"] for k in ((1, 0), (2, 0), (3, 40000), (None, 5))] == [0, 0, 10000, 2]
    assert found[4, 5000]["n_tokens"] == library("x" * 5000)
    long = found[3, 40000]
    assert long["over_limit"] and not found[None, 5]["over_limit"]
    assert tokens_within(long["prefix_tokens"], 11) == 3 and tokens_within(long["prefix_tokens"], 0) == 0
    cut = longest_prefix(long["prefix_tokens"], 2048)
    assert cut == long["fit_chars"] and library(("the cat " * 5000)[:cut]) == 2048
    assert library(("the cat " * 5000)[: cut + 1]) > 2048
    assert found[1, 0]["prefix_tokens"] == b""


def test_empty_table(documents):
    assert prefix_token_counts(documents([])).count() == 0


def test_query_equals_library(spark, table, library):
    rows = QUERIES["op1_token_counts"](spark, TABLES).collect()
    expected = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(rows) == len(expected)
    for row in rows:
        text = expected[row["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), library(text))
        assert row["over_limit"] == (row["n_tokens"] > 2048)
