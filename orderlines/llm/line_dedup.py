"""Line dedup by pairwise alignment of documents that share lines.

Lines meet by hash. A line of few documents (at most RARE) pairs each of them with every other; a
line of more documents pairs each with the first one that has it, so no line loses its link and no
group is paired with itself. A pair carries the positions, in both documents, of the lines that
brought it together; what else the two share is in a pair with a still earlier document. As a line
of many documents meets no other holder, what the order of the two documents leaves of it is
matched on its own, as often as the first holder has it; what a later document has of it beyond
that stays, even where another earlier one repeats it as often. The patience diff takes the lines that are unique in
both, keeps their longest increasing run, and goes on between those anchors with lines that are
unique there; equal lines next to a match are joined to it. Matched lines are deleted from the
later document (greater key), where they form blocks of at least MIN_WORDS words.

Lines are compared in lower case with spaces collapsed; blank lines match nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlines.functions.storage import materialize
from orderlines.llm.texts import TEXT_BYTES, slices

#: Documents of a line that are all paired with each other.
RARE = 8
#: Words of a block of aligned lines that is deleted.
MIN_WORDS = 8
ADDED = ("n_lines", "n_deleted", "n_words_deleted")


def patience(first: list, second: list) -> list[tuple[int, int]]:
    """Matched positions (i, j), rising in both, of two sequences."""
    matched: list[tuple[int, int]] = []
    spans = [(0, len(first), 0, len(second))]
    while spans:
        a, b, c, d = spans.pop()
        while a < b and c < d and first[a] == second[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and first[b - 1] == second[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(first[a:b]), Counter(second[c:d])
        where = {second[j]: j for j in range(c, d)}
        unique = [(i, where[first[i]]) for i in range(a, b) if left[first[i]] == 1 and right.get(first[i]) == 1]
        if not unique:
            continue
        # Longest run of rising positions: the least last position of each length, with its predecessor.
        tails, at, back = [], [], []
        for k, (_, j) in enumerate(unique):
            length = bisect_left(tails, j)
            tails[length : length + 1] = [j]
            at[length : length + 1] = [k]
            back.append(at[length - 1] if length else -1)
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(unique[k])
            k = back[k]
        i0, j0 = a, c
        for i, j in reversed(chain):
            spans.append((i0, i, j0, j))
            matched.append((i, j))
            i0, j0 = i + 1, j + 1
        spans.append((i0, b, j0, d))
    return sorted(matched)


def _line_hashes(text: Column) -> Column:
    """Per line its hash, null for a blank one."""
    plain = lambda line: F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
    hashed = lambda line: F.when(line != "", F.xxhash64(line))
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), plain), hashed)


def shared_lines(docs: DataFrame, text: str, key: str, rare: int = RARE) -> DataFrame:
    """Rows (later, later_text, matches): per pair the shared lines as (line, position, place in the earlier, common).

    Documents are told apart by key and hash of the text and ordered by them, null keys last.
    """
    named = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), _line_hashes(F.col(text)).alias("lines"))
    exploded = (
        named.select("id", "text_hash", F.posexplode("lines").alias("at", "line"))
        .where("line IS NOT NULL")
        .groupBy("line", "id", "text_hash")
        .agg(F.array_sort(F.array_distinct(F.collect_list("at"))).alias("places"))
    )
    lines = materialize(exploded, "lines")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "places")
    holders = lines.groupBy("line").agg(F.count(F.lit(1)).alias("holders"), F.min(order).alias("first"))
    held = materialize(holders.where("holders > 1"), "shared-lines")
    common = held.where(F.col("holders") > rare).select("line", "first")
    with_first = lines.join(common, "line").select(
        "line", order.alias("later"), F.col("first").alias("earlier"), F.lit(True).alias("common")
    )
    few = lines.join(held.where(F.col("holders") <= rare).select("line"), "line")
    groups = few.groupBy("line").agg(F.array_sort(F.collect_list(order)).alias("all"))
    paired = groups.select("line", "all", F.posexplode("all").alias("n", "later")).select(
        "line", "later", F.explode(F.slice("all", F.lit(1), F.col("n"))).alias("earlier"), F.lit(False).alias("common")
    )
    pairs = with_first.unionByName(paired).where(
        ~(F.col("earlier.id").eqNullSafe(F.col("later.id")) & (F.col("earlier.text_hash") == F.col("later.text_hash")))
    )
    return pairs.groupBy(
        F.col("later.id").alias("id"), F.col("later.text_hash").alias("text_hash"),
        F.col("earlier.id").alias("of"), F.col("earlier.text_hash").alias("of_hash"),
    ).agg(F.collect_list(F.struct("line", F.col("later.places").alias("at"), F.col("earlier.places").alias("of"), "common")).alias("matches"))


def _alone(matches: list[dict], matched: list[int]) -> list[int]:
    """Places of common lines that the alignment left, up to as many as the first holder has."""
    found, taken = [], set(matched)
    for match in matches:
        if match["common"]:
            left = [at for at in match["at"] if at not in taken]
            aligned = len(match["at"]) - len(left)
            found += left[: max(0, min(len(match["at"]), len(match["of"])) - aligned)]
    return found


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for matches in batch.column("matches").to_pylist():
            if len(matches) == 1 and len(matches[0]["at"]) == len(matches[0]["of"]) == 1:
                found.append(matches[0]["at"])
                continue
            later = sorted((at, m["line"]) for m in matches for at in m["at"])
            earlier = sorted((of, m["line"]) for m in matches for of in m["of"])
            pairs = patience([line for _, line in earlier], [line for _, line in later])
            places = [later[j][0] for _, j in pairs]
            found.append(places + _alone(matches, places))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.int32()))], ["id", "text_hash", "places"]
        )


def delete_lines(text: bytes | None, places: list[int] | None, min_words: int) -> tuple[bytes | None, int, int, int]:
    """The text without the blocks of deleted lines, its lines, deleted lines and deleted words.

    A block is a run of deleted lines with nothing but blank lines between them.
    """
    if text is None:
        return None, 0, 0, 0
    lines = text.split(b"\n")
    if not places:
        return text, len(lines), 0, 0
    matched, gone, block, words = set(places), set(), [], 0
    total = 0
    for at in range(len(lines) + 1):
        count = len(lines[at].split()) if at < len(lines) else 0
        if at < len(lines) and (at in matched or (block and not count)):
            block.append(at)
            words += count
            continue
        while block and block[-1] not in matched:
            block.pop()
        if words >= min_words:
            gone.update(block)
            total += words
        block, words = [], 0
    if not gone:
        return text, len(lines), 0, 0
    return b"\n".join(line for at, line in enumerate(lines) if at not in gone), len(lines), len(gone), total


def dedup_lines(
    docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """All rows with the blocks deleted from their text that an earlier document has as well.

    Adds n_lines, n_deleted and n_words_deleted. A document that loses all its lines keeps a text
    without words. Null texts stay null. Rows that repeat key and text count as one document and
    keep or lose the same lines. Texts of one key are ordered by their hash. An empty table gives an
    empty result. Columns named like the added ones are replaced.
    """
    pairs = shared_lines(docs, text, key, rare)
    kind = docs.schema[key].dataType
    aligned = pairs.select("id", "text_hash", "matches").mapInArrow(
        _align, T.StructType().add("id", kind).add("text_hash", T.LongType()).add("places", T.ArrayType(T.IntegerType()))
    )
    marked = (
        aligned.select("id", "text_hash", F.explode("places").alias("place"))
        .groupBy("id", "text_hash")
        .agg(F.collect_set("place").alias("_places"))
        .withColumnsRenamed({"id": "_id", "text_hash": "_text_hash"})
    )
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*kept).withColumn("_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(
        marked, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash")), "left"
    )
    source = joined.select(*[c for c in kept if c != text], F.col(text).cast("binary").alias(TEXT_BYTES), "_places")
    schema = T.StructType([docs.schema[c] for c in kept if c != text]).add(text, T.BinaryType())
    for name in ADDED:
        schema = schema.add(name, T.LongType())
    types = [field.type for field in to_arrow_schema(schema)]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column(TEXT_BYTES), batch.column("_places")
            for start, stop in slices(texts):
                pairs = zip(*(column.slice(start, stop - start).to_pylist() for column in (texts, places)))
                made = zip(*(delete_lines(t, p, min_words) for t, p in pairs))
                arrays = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 2)]
                arrays += [pa.array(values, kind) for values, kind in zip(made, types[-4:])]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(rebuild, schema).select(
        *[F.col(c).cast("string").alias(c) if c == text else c for c in kept], *ADDED
    )
