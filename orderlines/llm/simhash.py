"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most 2h share a variant that is at most h bits from either.
So every distinct fingerprint gives all its variants within h bits (2,081 for h = 2 of 64 bits),
equal variants meet, and the fingerprints that meet are linked: all of them lie within 2h of each
other, so links from the least one to the rest lose no connection, and no pairs are listed.

The shuffle is by a linear checksum of the variant. The checksum of ``x ^ mask`` is that of ``x``
xor that of ``mask``, so a bucket can tell which masks of a fingerprint lead into it: the bucket
gets the fingerprint once and makes its own share of the variants, each in exactly one bucket. That
moves 8 bytes for about 8 variants. Every bucket gets an equal share whatever the data are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize
from orderlines.llm.components import connected_components
from orderlines.llm.texts import map_texts

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of one message to a bucket.
CHUNK = 4096
BUCKET_BITS = 8
#: Fingerprints that a bucket may hold before there are more buckets, and variants of one pass in it.
BUCKET_FINGERPRINTS = 8_000_000
PASS_VARIANTS = 4_000_000
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, words_in: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a text; zero for one without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(words_in, len(words))
    count = len(words) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, BLOCK):
        block = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def _masks(half: int) -> np.ndarray:
    chosen = [c for size in range(half + 1) for c in combinations(range(BITS), size)]
    return np.array([sum(1 << bit for bit in bits) for bits in chosen], np.uint64)


def _checksums(values: np.ndarray, bits: int) -> np.ndarray:
    """Linear checksums: the xor of one fixed number per set bit, from a hash of the bit's place."""
    label = [xxhash.xxh64_intdigest(bytes([bit]), SEED) & ((1 << bits) - 1) for bit in range(BITS)]
    sums = np.zeros(len(values), np.uint32)
    for byte in range(8):
        table = np.zeros(256, np.uint32)
        for bit in range(8):
            table[1 << bit : 2 << bit] = table[: 1 << bit] ^ np.uint32(label[8 * byte + bit])
        sums ^= table[(values >> np.uint64(8 * byte)).astype(np.uint8)]
    return sums


def _forest(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least member, member) with the same components as the given links."""
    nodes, places = np.unique(np.r_[first, second], return_inverse=True)
    a, b = places[: len(first)], places[len(first) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    below = root != np.arange(len(nodes))
    return nodes[root[below]], nodes[below]


def links_in_bucket(values: np.ndarray, bucket: int, bucket_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints whose common variants fall into the bucket."""
    masks = _masks(half)
    passes = max(0, math.ceil(math.log2(max(1, len(values) * len(masks) / (1 << bucket_bits)) / PASS_VARIANTS)))
    bits = bucket_bits + passes
    values = np.sort(values)
    checks, mask_checks = _checksums(values, bits), _checksums(masks, bits)
    order = np.argsort(mask_checks, kind="stable")
    masks, edges = masks[order], np.searchsorted(mask_checks[order], np.arange((1 << bits) + 1))
    by_check = np.argsort(checks, kind="stable")
    present, begins = np.unique(checks[by_check], return_index=True)
    groups = list(zip(present.tolist(), begins.tolist(), np.r_[begins[1:], len(checks)].tolist()))
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for part in range(1 << passes):
        target = part << bucket_bits | bucket
        variants, owners = [], []
        for check, start, stop in groups:
            low, high = edges[check ^ target], edges[(check ^ target) + 1]
            if low < high:
                members = by_check[start:stop]
                variants.append((values[members, None] ^ masks[None, low:high]).ravel())
                owners.append(np.repeat(members, high - low))
        if not variants:
            continue
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        sorting = np.argsort(variant, kind="stable")
        variant, owner = variant[sorting], owner[sorting]
        again = np.r_[False, variant[1:] == variant[:-1]]
        if not again.any():
            continue
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(variant))))
        a, b = values[owner[lead[again]]], values[owner[again]]
        near = np.bitwise_count(a ^ b) <= 2 * half
        found.append(_forest(a[near], b[near]))
    first, second = (np.concatenate(side) for side in zip(*found))
    return _forest(first, second) if len(first) else (first, second)


def link_fingerprints(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct values of ``fingerprint``, connected like all pairs within ``radius``.

    Within ``radius`` each, no link joins others; every pair within it is connected by links.
    """
    if radius % 2:
        raise ValueError("the radius must be even: it is met from both sides")
    half = radius // 2
    count = fingerprints.count()
    bits = BUCKET_BITS + max(0, math.ceil(math.log2(max(1, count) / BUCKET_FINGERPRINTS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.zeros(1 << bits, bool)
        reached[_checksums(_masks(half), bits)] = True
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                values = batch.column(0).slice(start, CHUNK).to_numpy().view(np.uint64)
                checks = _checksums(values, bits)
                buckets, sent = [], []
                for bucket in range(1 << bits):
                    here = values[reached[checks ^ np.uint32(bucket)]]
                    if len(here):
                        buckets.append(bucket)
                        sent.append(here.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(sent, pa.binary())], ["bucket", "sent"])

    def meet(messages: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(messages["sent"].to_pylist()), np.uint64)
        a, b = links_in_bucket(values, messages["bucket"][0].as_py(), bits, half)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return (
        fingerprints.select("fingerprint")
        .mapInArrow(send, "bucket int, sent binary")
        .groupBy("bucket")
        .applyInArrow(meet, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    text: str = "text",
    key: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    links: DataFrame | None = None,
) -> DataFrame:
    """Groups of documents connected by fingerprints that differ in at most ``radius`` bits.

    ``links`` are further links (a, b) between fingerprints of the documents.

    Returns ``keep``, fingerprint (16 hex digits), component_id (least key of the group; null only
    if no row of it has a key) and component_key (one long per group). Null, empty and blank texts
    have the fingerprint zero. Equal texts share a fingerprint and so a group, however many there
    are. An empty table gives an empty result. A kept column with the name of a result gives way.
    """
    def prints(texts: list[bytes | None]) -> list:
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    names = tuple(dict.fromkeys((*(n for n in keep if n not in ("fingerprint", "component_id", "component_key")), key)))
    rows = materialize(map_texts(docs, prints, "fingerprint long", text, names), "fingerprints")
    distinct = materialize(rows.groupBy("fingerprint").agg(F.min(key).alias("least")), "distinct-fingerprints")
    near = link_fingerprints(distinct, radius)
    groups = connected_components(near if links is None else near.unionByName(links))
    labelled = distinct.join(groups, distinct["fingerprint"] == groups["node"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component_key")
    )
    labelled = materialize(labelled, "labels")
    least = labelled.groupBy("component_key").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(least, "component_key").select("fingerprint", "component_id", "component_key")
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    kept = [name for name in keep if name in names]
    return rows.join(of_print, "fingerprint").select(*kept, digits, "component_id", "component_key")


def keep_first(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each group of ``near_duplicates``: that with the least key, and one of its copies."""
    least = grouped.where(F.col(key).eqNullSafe(F.col("component_id")))
    return least.dropDuplicates(["component_key"]).drop("fingerprint", "component_id", "component_key")
