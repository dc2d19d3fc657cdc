"""Secret scan: keyword automaton, anchored patterns near its hits, then embedded checksums.

One Aho-Corasick pass over the text with A-Z lowered finds every keyword. At each hit the pattern
of its kind is matched anchored at that place, left to right and without overlap per kind, so no
expression walks the rest of a text. Runs of hex digits have no keyword: a run of HEX_LENGTH digits
covers HEX_PROBES neighbouring multiples of HEX_STRIDE, so every HEX_STRIDE-th character is looked
at and a run is taken up only around such probes. Kinds whose tokens carry a checksum are reported
only if it holds.

Texts are searched as UTF-8 bytes (read as one character a byte, since all patterns are ASCII);
spans are given in code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from orderlines.llm.texts import map_texts

HEX_LENGTH = 24
HEX_STRIDE = 8
HEX_PROBES = HEX_LENGTH // HEX_STRIDE
ACCESS_LENGTH = 20
VALUE_LENGTH = 6
RESULTS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# The alphabets and constants of the published token formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PROBES = re.compile(f"[0-9a-f]{{{HEX_PROBES},}}")


def _crc_base62(token: str) -> bool:
    """The last six characters are the CRC-32 of the ones before, after the prefix."""
    body, check = token.split("_", 1)[1][:-6], token[-6:]
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits == check


def _bech32(token: str) -> bool:
    """Checksum of the bech32 format."""
    prefix, data = token.lower().rsplit("1", 1)
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    state = 1
    for value in values + [BECH32.index(c) for c in data]:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ value
        for bit, factor in enumerate(BECH32_GENERATOR):
            if top >> bit & 1:
                state ^= factor
    return state == 1


def _base58(token: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the ones before."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    if number.bit_length() > 8 * 82:
        return False
    raw = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


# Kinds with a checksum: (name, keywords in lower case, anchored pattern, check).
CHECKED: tuple[tuple[str, tuple[str, ...], re.Pattern, Callable[[str], bool]], ...] = (
    (
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        _crc_base62,
    ),
    ("npm", ("npm_",), re.compile(r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _crc_base62),
    (
        "age",
        ("age-secret-key-1",),
        re.compile(r"(?<![A-Za-z0-9])AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![A-Za-z0-9])"),
        _bech32,
    ),
    ("xprv", ("xprv",), re.compile(r"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), _base58),
)
KINDS = ("assign", "access", "hex", *(kind for kind, *_ in CHECKED))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    words = {word: ("assign", len(word)) for word in ("password", "passwd", "secret", "token", "apikey", "api_key")}
    words["akia"] = ("access", 4)
    for kind, keywords, *_ in CHECKED:
        words |= {word: (kind, len(word)) for word in keywords}
    automaton = ahocorasick.Automaton()
    for word, value in words.items():
        automaton.add_word(word, value)
    automaton.make_automaton()
    return automaton


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for probe in PROBES.finditer(text[::HEX_STRIDE]):
        at = probe.start() * HEX_STRIDE
        # The run may begin up to a stride before its first probe, and break between two probes.
        end = probe.end() * HEX_STRIDE
        at = max(done, at - HEX_STRIDE + 1)
        while at < min(end, len(text)):
            run = HEX.match(text, at)
            if run is None:
                at += 1
                continue
            if run.end() - at >= HEX_LENGTH:
                yield at, run.end()
            at = run.end()
        done = max(done, at)


def find_secrets(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, in bytes."""
    raw = text.decode("latin-1")
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in _automaton().iter(text.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last - length + 1)
    anchored = {kind: (pattern, check) for kind, _, pattern, check in CHECKED}
    for kind, starts in hits.items():
        end = 0
        for start in sorted(starts):
            if start < end:
                continue
            if kind == "assign":
                match = ASSIGN.match(raw, start)
                good = match is not None and len(match[1]) >= VALUE_LENGTH
            elif kind == "access":
                match = ACCESS.match(raw, start)
                good = match is not None and len(match[0]) >= ACCESS_LENGTH
            else:
                pattern, check = anchored[kind]
                match = pattern.match(raw, start)
                good = match is not None and check(match[0])
            if match is not None:
                end = match.end()
            if good:
                found[kind].append(match.span())
    found["hex"] = list(_hex_runs(raw))
    return found


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in sorted(spans))


def _scan(texts: list[bytes | None]) -> list:
    rows = []
    for text in texts:
        text = text or b""
        found = find_secrets(text)
        spans = [(start, KINDS.index(kind), stop) for kind, places in found.items() for start, stop in places]
        if spans and not text.isascii():
            inner = (np.frombuffer(text, np.uint8) & 0xC0) == 0x80
            before = np.r_[0, np.cumsum(inner)]
            spans = [(int(start - before[start]), kind, int(stop - before[stop])) for start, kind, stop in spans]
        base = _digest([span for span in spans if span[1] < 3])
        rows.append(
            (
                len(found["assign"]),
                len(found["access"]),
                len(found["hex"]),
                hashlib.sha256(base.encode()).hexdigest(),
                _digest(spans),
            )
        )
    return list(zip(*rows))


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets in every text, whole.

    Returns ``keep`` and n_assign, n_access, n_hex, base_sha256 (of the spans of those three kinds)
    and spans: ``kind:start:end`` by start, joined by commas, in code points, end exclusive. A null
    or empty text has no spans. Repeated rows get one result each; an empty table gives none. A
    kept column with the name of a result gives way to it.
    """
    return map_texts(docs, _scan, RESULTS, text, keep)
