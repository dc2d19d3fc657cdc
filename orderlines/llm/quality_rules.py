"""Quality rules from repetition, found with suffix arrays over the words of each text.

Suffix array: prefix doubling over word ids. Only positions whose rank is still tied are sorted
again, and the ranks of every doubling step are kept, so that the common prefix of neighbouring
suffixes follows from comparing ranks from the largest step down. Many texts share one array; the
document is part of a word's id, so no repeat crosses documents.

A suffix whose common prefix with a neighbour has m words starts a repeated substring of m words;
runs of equal common-prefix values are the intervals of one repeat. The union of the spans
[p, p + m) with m >= MIN_REPEAT is the repeated part of a text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from orderlines.llm.texts import map_texts

#: Words of a window that counts as repeated.
MIN_REPEAT = 8
MIN_WORDS = 20
BASE_PERCENT = 30
#: A text goes when more than this share of the bytes of its words lies in repeats ...
MAX_COVERED = 0.25
#: ... or its longest repeat has more words than this.
MAX_REPEAT_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

RESULTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    "base_failed boolean, kept boolean, longest_repeat long, covered_fraction double,"
    "repeat_spans array<struct<start: int, stop: int>>"
)


def repeat_lengths(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per position, the words of the longest substring that starts there and occurs again.

    ``words`` are ids that no two documents share; ``ends`` is the end of each position's document.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(words, kind="stable")
    first = np.r_[True, words[order][1:] != words[order][:-1]]
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = starts[np.cumsum(first) - 1]
    tied = np.diff(np.r_[starts, n]) > 1
    active = order[np.repeat(tied, np.diff(np.r_[starts, n]))]
    steps, length = [rank.astype(np.int32)], 1
    while len(active):
        beyond = active + length
        second = np.where(beyond < ends[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        sorting = np.argsort(rank[active] * (n + 1) + second, kind="stable")
        active, second = active[sorting], second[sorting]
        old = rank[active]
        group = np.r_[True, old[1:] != old[:-1]]
        new = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        new_at = np.maximum.accumulate(np.where(new, at, 0))
        place = old + at - group_at
        order[place] = active
        rank = rank.copy()
        rank[active] = old + new_at - group_at
        last = np.r_[new[1:], True]
        active = active[~(new & last)]
        length *= 2
        if len(active):
            steps.append(rank.astype(np.int32))
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for step in range(len(steps) - 1, -1, -1):
        ranks, size = steps[step], 1 << step
        inside = (left + size <= ends[order[:-1]]) & (right + size <= ends[order[1:]])
        equal = inside & (ranks[np.minimum(left, n - 1)] == ranks[np.minimum(right, n - 1)])
        common += equal * size
        left += equal * size
        right += equal * size
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words."""
    at = np.flatnonzero(longest >= least)
    edges = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + longest[at], -1)
    return np.cumsum(edges[:-1]) > 0


def _examine(texts: list[bytes | None]) -> list:
    number = count().__next__
    pieces, counts = [], []
    n_words, chars, symbols, dup_lines = [], [], [], []
    for text in texts:
        text = text or b""
        words = text.split()
        ids = defaultdict(number)
        pieces.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        counts.append(np.fromiter(map(len, words), np.int64, len(words)))
        bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n_words.append(len(words))
        chars.append(int(bytes_of.sum() - bytes_of[0x80:0xC0].sum() - bytes_of[list(SPACES)].sum()))
        symbols.append(int(bytes_of[list(SYMBOLS)].sum()))
        lines = [line for line in text.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    stops = np.cumsum(n_words)
    begins = stops - n_words
    words, width = np.concatenate(pieces), np.concatenate(counts)
    document = np.repeat(np.arange(len(texts)), n_words)
    longest = repeat_lengths(words, np.repeat(stops, n_words))
    inside = covered(longest, MIN_REPEAT)
    repeated = np.bincount(document[inside], minlength=len(texts))
    weight = np.bincount(document, width, minlength=len(texts))
    share = np.bincount(document[inside], width[inside], minlength=len(texts)) / np.maximum(weight, 1)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, document, longest)
    total = np.array(n_words)
    failed = (total < MIN_WORDS) | (100 * repeated > BASE_PERCENT * total)
    kept = ~failed & (share <= MAX_COVERED) & (most <= MAX_REPEAT_WORDS)
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)) | np.isin(np.arange(len(inside) + 1), begins))
    spans = [[] for _ in texts]
    for start, stop in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if inside[start]:
            d = document[start]
            spans[d].append({"start": start - begins[d], "stop": stop - begins[d]})
    return [total, chars, symbols, dup_lines, repeated, failed, kept, most, share, spans]


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Repetition measures and verdict of every text, whole.

    Returns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, longest_repeat (words), covered_fraction (of the bytes in words) and repeat_spans (word
    positions, merged). A null or empty text has no words and fails. Repeated rows get one result
    each; an empty table gives none. A kept column with the name of a result gives way to it.
    """
    return map_texts(docs, _examine, RESULTS, text, keep)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with their columns."""
    judged = map_texts(docs, lambda texts: [_examine(texts)[6]], "_kept boolean", text, tuple(docs.columns))
    return judged.where("_kept").select(*docs.columns)
