"""Jaccard join of documents on their five-word shingles: a size-aware heavy-light join.

The order. All shingles are counted in packed form (a chunk of texts sends each bucket of the hash space its distinct
shingles once). Shingles of COMMON or more texts get a level by the magnitude of their count; all others have level
zero. Sets are sorted by (level, hash), so rare shingles stand first. Any fixed order gives the same result, so
the broadcast of levels may be bounded (MOST_COMMON) without a loss.

The signatures. Two sets of Jaccard t or more share at least c of the first n - ceil(t n) + c shingles
of either. A small set enumerates all subsets of SUBSET = 2 shingles of that prefix, and small sets meet
where a subset is equal. A large set posts its prefix for c = 1 to inverted lists and scans the
lists it is in; small sets that are large enough to match a large one post theirs as well, but do not
scan. The boundary between small and large is the size at which the cost is least: subsets to shuffle on
one side, list entries to scan on the other, from the histogram of sizes and the mean list length.

The pairs. A list or subset group never becomes all its pairs. In each of ROUNDS rounds a group pairs its
members with one leader (the least position first, since a set with few rare shingles is nearest to the
rest), the pairs are counted exactly on the shingle hashes, and the links contract the sets to
components. What the rounds leave apart meets the rest of its group at the end, once per pair, at the first
shingle the two prefixes share. Sets that are already connected are never compared again. Size and position
filters drop only pairs that cannot reach the similarity, so every link between different components
is found or implied.

Shingles are 64-bit hashes, equal sets are found by a 64-bit hash of their shingles. Null texts and
texts without words have no shingles and no links; fewer words than a shingle are one. Very long texts
are one set like others. An empty table gives an empty result. Repeated rows share a set. A
kept column with the name of a result gives way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize
from orderlines.llm.components import connected_components
from orderlines.llm.texts import map_texts

SHINGLE_WORDS = 5
#: The similarity as a fraction of whole numbers.
SIMILARITY = (80, 100)
SEED = 42
SUBSET = 2
ROUNDS = 3
#: Texts that a shingle must be in to have a level, and the most shingles with one (8 MB broadcast).
COMMON = 8
MOST_COMMON = 1 << 20
#: Sizes beyond this are large without a look at the cost: their subsets alone would number thousands.
SMALL_LIMIT = 256
#: Bits of a hash that tell shingles apart while they are counted.
SLOT_BITS = 40
CHUNK_SHINGLES = 1 << 21
#: Length of the tables of powers, unless a text is longer.
TABLE_BYTES = 1 << 18
#: Texts that are looked up by a broadcast of their hashes; more are found by a shuffle of the texts.
BROADCAST_TEXTS = 1 << 21
BUCKET_SHINGLES = 4_000_000
HISTOGRAM_GROUPS = 16
COUNTS = "kind int, key long, n long, squares long"
LEVEL, SIZE, TOTAL = 0, 1, 2


#: A number per byte, and an odd base, for hashes of byte ranges.
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([byte]), SEED) for byte in range(256)], np.uint64)
_BASE = xxhash.xxh64_intdigest(b"base", SEED) | 1


@lru_cache(maxsize=1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.full(length, base, np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finish, so that equal sums alone collide and order carries no pattern."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence where there are fewer words.

    A shingle is a range of the space-joined words. Its hash mixes its length and the sum of its bytes' numbers, each
    times a power of the base; sums of ranges are differences of running sums.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = np.frombuffer(b" ".join(words), np.uint8)
    powers, inverses = _powers(max(TABLE_BYTES, 1 << len(joined).bit_length()))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTES[joined] * powers[: len(joined)], out=sums[1:])
    gaps = np.flatnonzero(joined == 32)
    count = len(words) - size + 1
    starts = np.concatenate(([0], gaps + 1))[:count]
    ends = np.concatenate((gaps, [len(joined)]))[size - 1 :]
    hashes = _mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    hashes.sort()
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def prefix_length(size: int, shared: int, similarity: tuple[int, int]) -> int:
    """How many first shingles of a set hold ``shared`` of those it has in common with any match."""
    part, whole = similarity
    return min(size, size - -(-part * size // whole) + shared)


# ---- the order ------------------------------------------------------------------------------


def _packed(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Slots of a bucket as 32-bit values, and the counts of those that occur more than once."""
    again = np.flatnonzero(counts > 1).astype(np.uint32)
    values = (slots & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    head = np.array([len(values), len(again)], np.uint32)
    return b"".join(part.tobytes() for part in (head, values, again, counts[again].astype(np.uint32)))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(data, np.uint32)
    n, repeated = int(numbers[0]), int(numbers[1])
    counts = np.ones(n, np.int64)
    counts[numbers[2 + n : 2 + n + repeated]] = numbers[2 + n + repeated :]
    return numbers[2 : 2 + n], counts


def shingle_counts(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Rows (kind, key, n, squares): common shingles by slot, set sizes, and sums over the shingles below COMMON."""
    source = docs.select(F.col(f"`{text}`").cast("binary").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, math.ceil(math.log2(max(1, total / 6 / BUCKET_SHINGLES))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: Counter[int] = Counter()
        held, waiting, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            slots, counts = np.unique(np.concatenate(held) >> np.uint64(64 - SLOT_BITS), return_counts=True)
            edges = np.searchsorted(slots, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(SLOT_BITS - bits))
            spans = [(b, edges[b], edges[b + 1]) for b in range(1 << bits) if edges[b] < edges[b + 1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in spans], pa.int32()),
                    pa.array([_packed(slots[i:j], counts[i:j]) for _, i, j in spans], pa.binary()),
                ],
                ["bucket", "sent"],
            )

        for batch in batches:
            for value in batch.column(0):
                found = shingle_set(value.as_py(), size)
                if not len(found):
                    continue
                sizes[min(len(found), SMALL_LIMIT)] += 1
                same = xxhash.xxh64_intdigest(found.tobytes())
                if same in seen:
                    continue
                seen.add(same)
                held.append(found)
                waiting += len(found)
                if waiting >= CHUNK_SHINGLES:
                    yield flush()
                    held, waiting, seen = [], 0, set()
        if held:
            yield flush()
        if sizes:
            group = -1 - TaskContext.get().partitionId() % HISTOGRAM_GROUPS
            entries = np.array(sorted(sizes.items()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int32()), pa.array([entries.tobytes()], pa.binary())], ["bucket", "sent"]
            )

    def add(messages: pa.Table) -> pa.Table:
        bucket = messages["bucket"][0].as_py()
        rows: list[tuple[int, int, int, int]] = []
        if bucket < 0:
            sizes: Counter[int] = Counter()
            for value in messages["sent"]:
                for number, n in np.frombuffer(value.as_py(), np.int64).reshape(-1, 2).tolist():
                    sizes[number] += n
            rows = [(SIZE, number, n, 0) for number, n in sizes.items()]
        else:
            slots, counts = (np.concatenate(side) for side in zip(*(_unpacked(v.as_py()) for v in messages["sent"])))
            order = np.argsort(slots, kind="stable")
            slots, starts = np.unique(slots[order], return_index=True)
            counts = np.add.reduceat(counts[order], starts)
            common = counts >= COMMON
            high = bucket >> (bits - (SLOT_BITS - 32)) << 32
            rows = [(LEVEL, high + slot, n, 0) for slot, n in zip(slots[common].tolist(), counts[common].tolist())]
            rest = counts[~common]
            rows.append((TOTAL, 0, int(rest.sum()), int((rest * rest).sum())))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "key", "n", "squares"])

    return materialize(
        source.mapInArrow(send, "bucket int, sent binary").groupBy("bucket").applyInArrow(add, COUNTS), "shingle-counts"
    )


def common_levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the commonest shingles, ascending, and their levels."""
    top = (
        counts.where(F.col("kind") == LEVEL).orderBy(F.desc("n"), "key").limit(MOST_COMMON)
        .select("key", F.floor(F.log2("n") * 4).cast("int").alias("level")).toArrow()
    )
    slots, levels = top["key"].to_numpy().astype(np.uint64), top["level"].to_numpy().astype(np.uint8)
    order = np.argsort(slots)
    return slots[order], levels[order]


def cheapest_boundary(counts: DataFrame, similarity: tuple[int, int]) -> int:
    """The greatest size of a small set, by the rows that subsets and list scans cost."""
    stats = counts.where(F.col("kind") != LEVEL).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    sizes, scan = {}, 1.0
    for row in stats.collect():
        if row["kind"] == SIZE:
            sizes[row["key"]] = row["n"]
        elif row["n"]:
            scan = row["squares"] / row["n"]

    def cost(boundary: int) -> float:
        rows = 0.0
        for size, n in sizes.items():
            listed = prefix_length(size, 1, similarity)
            if size <= boundary:
                rows += n * math.comb(prefix_length(size, SUBSET, similarity), SUBSET)
                rows += n * listed if size >= _least_posting(boundary, similarity) else 0
            else:
                rows += n * listed * (1 + scan)
        return rows

    return min(range(SMALL_LIMIT), key=lambda boundary: (cost(boundary), boundary))


def _least_posting(boundary: int, similarity: tuple[int, int]) -> int:
    """The least small set that a large one may match."""
    part, whole = similarity
    return -(-part * (boundary + 1) // whole)


# ---- signatures and pairs -------------------------------------------------------------------


def signed_sets(
    docs: DataFrame, counts: DataFrame, text: str, keep: tuple[str, ...], size: int, similarity: tuple[int, int]
) -> DataFrame:
    """Per row: ``keep``, text_hash, n_shingles, set_id, listed (prefix in order), scans, subsets (hashes)."""
    slots, levels = common_levels(counts)
    boundary = cheapest_boundary(counts, similarity)
    posting = _least_posting(boundary, similarity)

    def ordered(found: np.ndarray, length: int) -> np.ndarray:
        if not len(slots):
            return found[:length]
        own = found >> np.uint64(64 - SLOT_BITS)
        at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
        level = np.where(slots[at] == own, levels[at], 0)
        return found[np.argsort(level, kind="stable")[:length]]

    def sign(texts: list[bytes | None]) -> list:
        columns: list[list] = [[], [], [], [], []]
        for value in texts:
            found = shingle_set(value, size)
            n = len(found)
            small = n <= boundary
            first = ordered(found, prefix_length(n, SUBSET, similarity)) if n else found
            subsets = []
            if small and n:
                chosen = combinations(np.sort(first).tolist(), min(SUBSET, n))
                subsets = [xxhash.xxh64_intdigest(np.array(s, np.uint64).tobytes()) - (1 << 63) for s in chosen]
            listed = first[: prefix_length(n, 1, similarity)] if n >= posting else first[:0]
            identity = xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if n else None
            for column, cell in zip(columns, (n, identity, listed.view(np.int64).tolist(), not small, subsets)):
                column.append(cell)
        return columns

    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    results = "n_shingles long, set_id long, listed array<long>, scans boolean, subsets array<long>"
    names = tuple(name for name in dict.fromkeys(keep) if name != "text_hash")
    return map_texts(hashed, sign, results, text, (*names, "text_hash"))


def signature_groups(signed: DataFrame) -> DataFrame:
    """Rows (key, set_id, n, pos, scans, rank, members, leaders) of the signatures that two or more sets share.

    pos is 0 for subsets. The first ROUNDS ranks of a group are its leaders: those with the least position, since a set
    with few rare shingles of its own is nearest to the rest.
    """
    sets = signed.where("n_shingles > 0").select("set_id", F.col("n_shingles").cast("int").alias("n"), "listed", "scans", "subsets")
    sets = sets.dropDuplicates(["set_id"])
    entries = F.concat(
        F.transform("listed", lambda key, at: F.struct(key.alias("key"), (at + 1).cast("int").alias("pos"))),
        F.transform("subsets", lambda key: F.struct(key.alias("key"), F.lit(0).alias("pos"))),
    )
    rows = sets.select("set_id", "n", "scans", F.inline(entries))
    alike = Window.partitionBy("key", F.col("pos") > 0)
    ranked = rows.withColumns(
        {"members": F.count(F.lit(1)).over(alike), "rank": F.row_number().over(alike.orderBy("pos", F.xxhash64("set_id"), "set_id")) - 1}
    ).where("members > 1")
    leader = F.struct("set_id", "n", "pos", "scans")
    leaders = {f"leader_{r}": F.max(F.when(F.col("rank") == r, leader)).over(alike) for r in range(ROUNDS)}
    return materialize(ranked.withColumns(leaders), "signature-groups")


def _possible(n: Column, pos: Column, other_n: Column, other_pos: Column, similarity: tuple[int, int]) -> Column:
    """Whether sizes, and the positions of the first shared shingle, leave room for the similarity."""
    part, whole = similarity
    sizes = (F.least(n, other_n) * whole >= F.greatest(n, other_n) * part)
    most = F.when(pos > 0, F.least(n - pos, other_n - other_pos) + 1).otherwise(F.least(n, other_n))
    return sizes & (most * (whole + part) >= (n + other_n) * part)


def _leader_pairs(groups: DataFrame, number: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (first, second) of one leader of each group with the members after it."""
    leader = F.col(f"leader_{number}")
    scanned = (F.col("pos") == 0) | F.col("scans") | leader["scans"]
    fits = _possible(F.col("n"), F.col("pos"), leader["n"], leader["pos"], similarity)
    return groups.where((F.col("rank") > number) & scanned & fits).select(
        F.least("set_id", leader["set_id"]).alias("first"), F.greatest("set_id", leader["set_id"]).alias("second")
    ).distinct()


def _labelled(df: DataFrame, labels: DataFrame | None, sides: dict[str, str]) -> DataFrame:
    """Component labels for the sets of some columns; a set without links is its own."""
    for side, label in sides.items():
        if labels is None:
            df = df.withColumn(label, F.col(side))
            continue
        named = labels.withColumnsRenamed({"set_id": side, "label": label})
        df = df.join(named, side, "left").withColumn(label, F.coalesce(label, side))
    return df


def _remaining_pairs(groups: DataFrame, labels: DataFrame, prefixes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of the members after all leaders that are in different components.

    One side is never of the component of the group's first leader, so the greatest component of a group is not
    paired with itself. A pair is emitted at the first shingle its prefixes share: earlier ones must not meet.
    """
    alike = Window.partitionBy("key", F.col("pos") > 0)
    rest = groups.where((F.col("members") > ROUNDS + 1) & (F.col("rank") >= ROUNDS))
    main = F.col("leader_0.set_id") if ROUNDS else F.min("set_id").over(alike)
    rows = _labelled(rest.withColumn("main", main), labels, {"set_id": "label", "main": "main_label"})
    ends = {"low": F.min("label").over(alike), "high": F.max("label").over(alike)}
    split = rows.withColumns(ends).where("low != high").select("key", "set_id", "n", "pos", "scans", "label", "main_label")
    before = F.slice("listed", F.lit(1), F.greatest(F.col("pos") - 1, F.lit(0)))
    split = split.join(prefixes, "set_id").withColumn("before", before).drop("listed")
    x, y = split.where("label != main_label").alias("x"), split.alias("y")
    apart = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & ((F.col("x.pos") > 0) == (F.col("y.pos") > 0))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main_label")) | (F.col("x.set_id") < F.col("y.set_id")))
        & ((F.col("x.pos") == 0) | F.col("x.scans") | F.col("y.scans"))
        & _possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), similarity)
        & ~F.arrays_overlap("x.before", "y.before"),
    )
    return apart.select(
        F.least("x.set_id", "y.set_id").alias("first"), F.greatest("x.set_id", "y.set_id").alias("second")
    ).distinct()


def texts_by_hash(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Rows (text, text_hash) of the texts whose hashes are in ``wanted``, each once."""
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    value = F.col(f"`{text}`")
    hashed = docs.select(value.alias("text"), F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))).alias("text_hash"))
    return hashed.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])


def near_pairs(pairs: DataFrame, docs: DataFrame, texts: DataFrame, text: str, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Rows (first, second, near) by exact intersection; only sets of the pairs are made from their texts again."""
    part, whole = similarity
    pairs = materialize(pairs, "candidate-pairs")
    used = pairs.select(F.col("first").alias("set_id")).unionByName(pairs.select(F.col("second").alias("set_id"))).distinct()
    wanted = materialize(texts.join(used, "set_id", "left_semi").select("text_hash"), "wanted-texts")

    def arrays(values: list[bytes | None]) -> list:
        sets = [shingle_set(value, size) for value in values]
        identities = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
        return [identities, [s.tobytes() for s in sets]]

    found = map_texts(texts_by_hash(docs, text, wanted), arrays, "set_id long, hashes binary", "text", ())
    found = materialize(found, "candidate-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                left, right = (np.frombuffer(side.as_buffer(), np.uint64) for side in (a, b))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                near.append(whole * shared >= part * (len(left) + len(right) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("second"), pa.array(near, pa.bool_())], ["first", "second", "near"])

    joined = pairs.join(found.withColumnsRenamed({"set_id": "first", "hashes": "a"}), "first").join(
        found.withColumnsRenamed({"set_id": "second", "hashes": "b"}), "second"
    )
    checked = joined.select("first", "second", "a", "b").mapInArrow(check, "first long, second long, near boolean")
    return materialize(checked, "checked-pairs")


def linked_sets(
    signed: DataFrame, docs: DataFrame, text: str, size: int, similarity: tuple[int, int]
) -> tuple[DataFrame, DataFrame]:
    """Links (first, second) that connect all similar sets, and rows (set_id, label) of the sets they connect."""
    groups = signature_groups(signed)
    full = signed.where("n_shingles > 0")
    texts = materialize(full.groupBy("set_id").agg(F.min("text_hash").alias("text_hash")), "set-texts")
    prefixes = full.select("set_id", "listed").dropDuplicates(["set_id"])
    checked = labels = None
    for number in range(ROUNDS + 1):
        if number < ROUNDS:
            pairs = _leader_pairs(groups, number, similarity)
        else:
            pairs = _remaining_pairs(groups, labels, prefixes, similarity)
        pairs = _labelled(pairs, labels, {"first": "a", "second": "b"}).where("a != b").select("first", "second")
        if checked is not None:
            pairs = pairs.join(checked.select("first", "second"), ["first", "second"], "left_anti")
        now = near_pairs(pairs, docs, texts, text, size, similarity)
        checked = now if checked is None else checked.unionByName(now)
        if labels is not None and now.where("near").isEmpty():
            continue
        links = checked.where("near").select(F.col("first").alias("a"), F.col("second").alias("b"))
        labels = materialize(connected_components(links).select(F.col("node").alias("set_id"), F.col("component").alias("label")), "labels")
    return checked.where("near").select("first", "second"), labels


def shingle_components(
    docs: DataFrame,
    similarity: tuple[int, int] = SIMILARITY,
    size: int = SHINGLE_WORDS,
    text: str = "text",
    key: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Rows ``keep``, n_shingles, set_id, component_id: documents connected by links of ``similarity``.

    component_id is the least key of the component, null only where no row of it has a key. ``similarity`` is a
    fraction of two whole numbers and at least a half.
    """
    results = ("n_shingles", "set_id", "component_id")
    names = tuple(dict.fromkeys((*(n for n in keep if n not in results), key)))
    counts = shingle_counts(docs, text, size)
    signed = materialize(signed_sets(docs, counts, text, names, size, similarity), "signed-sets")
    _, labels = linked_sets(signed, docs, text, size, similarity)
    least = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.col(f"`{key}`")).alias("least"))
    labelled = materialize(
        least.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "labelled-sets"
    )
    first = labelled.groupBy("label").agg(F.min("least").alias("component"))
    of_set = labelled.join(first, "label").select("set_id", "component")
    own = F.when(F.col("n_shingles") == 0, F.col(f"`{key}`")).otherwise(F.col("component"))
    return signed.join(of_set, "set_id", "left").select(
        *[F.col(f"`{name}`") for name in keep if name in names], "n_shingles", "set_id", own.alias("component_id")
    )
