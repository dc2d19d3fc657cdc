"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair encoding, the tokens of a prefix are the tokens of a shorter prefix plus one last
token: the only vocabulary entry that ends there and is stable beside the token before it. So one
pass over a word fills, for every prefix, the last token and the count, without encoding anything
twice. Two neighbours are stable if no merge across their border comes before the merges that made
them; ``PrefixCounter._stable`` decides it from the merge ranks.

This vocabulary marks word ends, so each prefix has two states: inside a word (no mark yet) and
ended here. A word's counts are kept in a bounded memory of words; the counts of a text are those
of its words, shifted by the tokens before them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from orderlines.llm.texts import map_texts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Words, prefixes and pairs that a task remembers; beyond it the memory starts anew.
MEMORY = 600_000
#: Longest word, in code points, whose prefix states are shared with other words.
SHARED = 48
END = "</w>"

# The split of the vocabulary's own pre-tokenizer, \p{White_Space} for its \s, and
# the code points that its library does not take as letters or digits, though ``regex`` does.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LETTER, DIGIT = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{DIGIT}|[^\p{{White_Space}}{LETTER}{DIGIT}]+"
PIECE = regex.compile(rf"\p{{White_Space}}*(?:{SPLIT})|\p{{White_Space}}+", regex.V1)
SPACE = regex.compile(r"\p{White_Space}+")
CORE = regex.compile(SPLIT, regex.V1)
LETTERS = regex.compile(r"\p{L}+")
# The same split for texts below NARROW, in the classes that ``re`` handles faster.
NARROW = 0x250


def _listed(pattern: str) -> str:
    of = regex.compile(pattern, regex.V1)
    return "".join(re.escape(chr(code)) for code in range(NARROW) if of.match(chr(code)))


WIDE = re.compile(f"[^\\0-{chr(NARROW - 1)}]")
_SPACES, _LETTERS, _DIGITS = map(_listed, (r"\p{White_Space}", LETTER, DIGIT))
NARROW_PIECE = re.compile(
    f"[{_SPACES}]*(?:'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+)|[{_SPACES}]+"
)
# Lower case of letters that the library knows and this Python does not.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DC: 0x19B}
LOWER |= {code: code + 1 for code in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}
LOWER |= {code: code + 0x20 for code in range(0x10D50, 0x10D66)}
LOWER |= {code: code + 0x1B for code in range(0x16EA0, 0x16EB9)}
UPPER = regex.compile("[" + "".join(map(chr, LOWER)) + "]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


class _Spelling(dict):
    """A character's bytes in the vocabulary's byte characters."""

    def __init__(self, characters: list[str]):
        super().__init__()
        self._characters = characters

    def __missing__(self, character: str) -> str:
        spelled = self[character] = "".join(self._characters[b] for b in character.encode())
        return spelled


class PrefixCounter:
    """Token counts of every prefix under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.characters = _byte_characters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {left + right: (left, right) for left, right in reversed(merges)}
        self.made = {token: self.rank[pair] for token, pair in self.parts.items()}
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        single = set(self.characters)
        inner, final = set(single), {c + END for c in single}
        for left, right in merges:
            token = left + right
            if self.parts[token] != (left, right) or not self._stable(left, right, self.rank[left, right]):
                continue  # never the outcome of encoding its own characters
            (final if token.endswith(END) else inner).add(token)
        self.inner, self.final = inner, final
        self.longest = max(map(len, inner))
        self.longest_final = max(map(len, final)) - len(END)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.states: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.ends: dict[str, int] = {}
        self.spelled = _Spelling(self.characters)

    def _stable(self, left: str, right: str, before: float = float("inf")) -> bool:
        """No merge over the border happens before ``before``, nor before the sides are made.

        Equal ranks are merged from the left: the border goes first against a merge on its right.
        """
        rank, made, parts = self.rank, self.made, self.parts
        on_right = False
        while True:
            crossing = rank.get((left, right))
            if crossing is not None and (crossing < before or on_right and crossing == before):
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Undo the later of the two; of two equal ones the right one was made later.
            if a > b:
                left, before, on_right = parts[left][1], a, False
            else:
                right, before, on_right = parts[right][0], b, True

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            known = self.pairs[key] = self._stable(left, right)
        return known

    def _last_token(self, text: str, states: dict[str, tuple[str, int]]) -> tuple[str, int]:
        """Last token and token count of ``text`` as the start of a word that goes on."""
        inner, stop = self.inner, len(text)
        for start in range(max(0, stop - self.longest), stop):
            token = text[start:]
            if token in inner:
                last, count = states[text[:start]]
                if start == 0 or self._fits(last, token):
                    return token, count + 1
        raise ValueError(f"no token ends {text!r}")

    def _ended(self, text: str, states: dict[str, tuple[str, int]]) -> int:
        """Token count of ``text`` as a whole word."""
        final, stop = self.final, len(text)
        for start in range(max(0, stop - self.longest_final), stop):
            token = text[start:] + END
            if token in final:
                last, count = states[text[:start]]
                if start == 0 or self._fits(last, token):
                    return count + 1
        raise ValueError(f"no token ends {text!r}")

    def word(self, word: str) -> list[int]:
        """Counts of every non-empty prefix (by code point) of one pre-token, each ended there.

        Words share the states of their common prefixes; a very long word keeps its own.
        """
        if len(word) > SHARED:
            return self._long_word(word)
        if len(self.ends) >= MEMORY:
            self.states, self.ends = {"": ("", 0)}, {}
        states, ends = self.states, self.ends
        known = len(word)
        while known and word[:known] not in ends:
            known -= 1
        counts = [ends[word[:i]] for i in range(1, known + 1)]
        text = "".join(self.spelled[c] for c in word[:known])
        for i in range(known, len(word)):
            for character in self.spelled[word[i]]:
                text += character
                if text not in states:
                    states[text] = self._last_token(text, states)
            count = ends[word[: i + 1]] = self._ended(text, states)
            counts.append(count)
        return counts

    def _long_word(self, word: str) -> list[int]:
        """As ``word``, with one state per position and text windows of a token's length."""
        inner, final, width = self.inner, self.final, max(self.longest, self.longest_final)
        text, last, counts, found = "", [""], [0], []
        for c in word:
            text += self.spelled[c]
        stop = 0
        for c in word:
            for _ in self.spelled[c]:
                stop += 1
                for start in range(max(0, stop - width), stop):
                    token = text[start:stop]
                    if token in inner and (start == 0 or self._fits(last[start], token)):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
            for start in range(max(0, stop - width), stop):
                token = text[start:stop] + END
                if token in final and (start == 0 or self._fits(last[start], token)):
                    found.append(counts[start] + 1)
                    break
        return found

    def _piece(self, piece: str) -> bytes:
        """Counts inside a piece (spaces, then at most one pre-token), 32 bits each."""
        core = piece.lstrip(" \t\n\v\f\r") if piece.isascii() else SPACE.sub("", piece, count=1) if SPACE.match(piece) else piece
        counts = [0] * (len(piece) - len(core))
        if core:
            if core[0] == "'" and LETTERS.search(core):
                # A contraction: what its prefixes are split into differs from their parent.
                for stop in range(1, len(core) + 1):
                    counts.append(sum(self.word(part)[-1] for part in CORE.findall(core[:stop])))
            else:
                counts += self.word(core)
        if len(self.words) >= MEMORY:
            self.words.clear()
        known = self.words[piece] = np.array(counts, np.int32).tobytes()
        return known

    def _ordinary(self, text: str) -> np.ndarray:
        pieces = (PIECE if WIDE.search(text) else NARROW_PIECE).findall(text)
        if not pieces:
            return np.zeros(0, np.int64)
        words, piece_of = self.words, self._piece
        inside = np.frombuffer(b"".join([words.get(piece) or piece_of(piece) for piece in pieces]), np.int32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        totals = inside[np.cumsum(lengths) - 1]
        return inside + np.repeat(np.cumsum(totals) - totals, lengths)

    def normalize(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if UPPER.search(text):
                text = text.translate(LOWER)
            # Character by character, so without the rules that look at neighbours.
            return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return text.lower()

    def counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix: entry i is for the first i + 1 code points of the normal form.

        Special strings are one token when complete, and ordinary text while they are cut.
        """
        found, before, start = [], 0, 0
        for special in self.special.finditer(text):
            body = self.normalize(text[start : special.start()])
            both = self._ordinary(body + self.normalize(special[0][:-1]))
            found += [before + both, np.array([before + 1 + (both[len(body) - 1] if body else 0)])]
            before, start = int(found[-1][0]), special.end()
        found.append(before + self._ordinary(self.normalize(text[start:])))
        return np.concatenate(found)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokens_within(prefix_tokens: bytes, characters: int) -> int:
    """Tokens of the first ``characters`` code points."""
    stored = np.frombuffer(prefix_tokens, np.int32)
    return int(stored[min(characters, len(stored)) - 1]) if characters > 0 and len(stored) else 0


def longest_prefix(prefix_tokens: bytes, budget: int) -> int:
    """Code points of the longest prefix that needs at most ``budget`` tokens."""
    within = np.flatnonzero(np.frombuffer(prefix_tokens, np.int32) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_token_counts(
    docs: DataFrame,
    limit: int = LIMIT,
    vocabulary: str | None = None,
    store: bool = True,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Token counts of every whole text and of all its prefixes.

    Returns ``keep``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), fit_chars (code points
    of the longest prefix within ``limit``) and, unless ``store`` is false, prefix_tokens: one
    32-bit count per code point of the normal form (composed, lower case), for ``tokens_within`` and
    ``longest_prefix``. A null or empty text has no tokens and an empty store. Repeated rows get one
    result each; an empty table gives none. A kept column with the name of a result gives way to it.
    The vocabulary file must be at the same path on every machine.
    """
    path = vocabulary or default_vocabulary()

    def count(texts: list[bytes | None]) -> list:
        counting = counter(path)
        rows = []
        for raw in texts:
            counts = counting.counts((raw or b"").decode("utf-8", "replace"))
            total = int(counts[-1]) if len(counts) else 0
            fit = len(counts)
            if total > limit or len(counts) and counts.max() > limit:
                fit = int(np.flatnonzero(counts <= limit)[-1]) + 1 if (counts <= limit).any() else 0
            row = [len(raw or b""), total, total > limit, fit]
            rows.append(row + [counts.astype(np.int32).tobytes()] if store else row)
        return [list(column) for column in zip(*rows)]

    results = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_texts(docs, count, results + ", prefix_tokens binary" * store, text, keep)
