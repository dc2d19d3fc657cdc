"""Language-model scores by deleted interpolation.

P(w | h) = a2 c(h, w) / c(h) + a1 c(w) / N + a0 / (V + 1), with one set of weights per bucket of
context frequency (none, 1, 2-3, 4-7, ...). The weights come from expectation-maximisation on
held-out counts: one part of the training texts (remainder TUNE) is left out of the counts, and the
weights that make it likeliest under the other counts are kept; the final model counts all
training texts.

Texts are numbered into chunks of bounded size, written once. A chunk sends each bucket of the key
space its distinct words and word pairs (64-bit hashes, packed, with its own counts); the bucket
adds up all chunks and answers each with totals in the order of its keys. So what is shuffled is
merged per chunk, a frequent word or pair costs one entry a chunk, and no count passes through the
driver: only N, V and the weights do.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count as counting

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlines.functions.storage import materialize
from orderlines.llm.texts import TEXT_BYTES, held_out_remainder, small_batches

HELD_OUT = 1
TUNE = 0
CHUNK_BYTES = 4 << 20
#: Tokens per bucket of the key space, on average.
BUCKET_TOKENS = 2_000_000
FREQUENCY_BUCKETS = 40
ROUNDS = 20
SETTLED = 1e-4
START = xxhash.xxh64_intdigest(b" ")
END = xxhash.xxh64_intdigest(b"")
RESULTS = (
    "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, its width first."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of 64-bit hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0xD1B54A32D192ED03))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def number_texts(docs: DataFrame, text: str, key: str, keep: tuple[str, ...]) -> DataFrame:
    """Chunks of texts as word numbers: rows (chunk, tune, ``keep`` as arrays, remainders, lengths, words, ids).

    ``words`` are the hashes of the chunk's distinct words, the end first; ``ids`` number the tokens
    of all its texts, each text closed by the end; ``lengths`` are tokens per text.
    """
    source = docs.select(
        *[F.col(f"`{name}`") for name in keep],
        held_out_remainder(key).cast("int").alias("_remainder"),
        F.col(f"`{text}`").cast("binary").alias(TEXT_BYTES),
    )
    schema = T.StructType().add("chunk", T.LongType()).add("tune", T.BooleanType())
    for name in keep:
        schema = schema.add(f"keep_{name}", T.ArrayType(source.schema[name].dataType))
    for name in ("remainders", "lengths", "words", "ids"):
        schema = schema.add(name, T.BinaryType())
    schema = schema.add("tokens", T.LongType())
    arrow = to_arrow_schema(schema)

    class Chunk:
        def __init__(self):
            number = counting(1).__next__
            self.numbers = defaultdict(number)
            self.ids, self.lengths, self.remainders, self.kept, self.size = [], [], [], [], 0

        def add(self, text: bytes, remainder: int) -> None:
            words = text.lower().split()
            self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.ids.append(np.zeros(1, np.int32))
            self.lengths.append(len(words) + 1)
            self.remainders.append(remainder)
            self.size += len(text) + 16

        def row(self, number: int, tune: bool) -> pa.RecordBatch:
            words = [END, *map(xxhash.xxh64_intdigest, self.numbers)]
            kept = [pa.ListArray.from_arrays(pa.array([0, len(self.lengths)], pa.int32()), pa.concat_arrays([k[i] for k in self.kept])) for i in range(len(keep))]
            blobs = [
                np.array(self.remainders, np.int8).tobytes(),
                np.array(self.lengths, np.int32).tobytes(),
                np.array(words, np.uint64).tobytes(),
                np.concatenate(self.ids).tobytes(),
            ]
            arrays = [pa.array([number]), pa.array([tune]), *kept, *[pa.array([b], pa.binary()) for b in blobs], pa.array([sum(self.lengths)])]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        chunks, sent = {False: Chunk(), True: Chunk()}, 0
        for batch in batches:
            remainders = batch.column(len(keep)).to_pylist()
            for row, value in enumerate(batch.column(len(keep) + 1)):
                text = value.as_py()
                tune = remainders[row] == TUNE
                chunk = chunks[tune]
                if chunk.size and chunk.size + len(text or b"") > CHUNK_BYTES:
                    yield chunk.row(base + sent, tune)
                    chunk, sent = Chunk(), sent + 1
                    chunks[tune] = chunk
                chunk.add(text or b"", remainders[row])
                chunk.kept.append([batch.column(i).slice(row, 1) for i in range(len(keep))])
        for tune, chunk in chunks.items():
            if chunk.lengths:
                yield chunk.row(base + sent, tune)
                sent += 1

    return source.mapInArrow(run, schema)


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """One row at a time as Python values, so that memory follows the row and not the batch."""
    for at in range(table.num_rows):
        yield table.slice(at, 1).to_pylist()[0]


class Numbered:
    """A chunk's tokens, its distinct pairs, and the order in which keys go to the buckets."""

    def __init__(self, row: dict, bits: int):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.ids = np.frombuffer(row["ids"], np.int32)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.remainders = np.frombuffer(row["remainders"], np.int8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        size = len(self.words)
        # The start of a text is a context of its own, numbered after the words.
        self.context = np.r_[np.int32(size), self.ids[:-1]]
        self.context[self.begins] = size
        pairs, self.pair_of = np.unique(self.context.astype(np.int64) * (size + 1) + self.ids, return_inverse=True)
        self.pair_context, self.pair_word = pairs // (size + 1), pairs % (size + 1)
        known = np.r_[self.words, np.uint64(START)]
        self.keys = {1: self.words, 2: _pair_keys(known[self.pair_context], known[self.pair_word])}
        self.order, self.edges = {}, {}
        for n, keys in self.keys.items():
            bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
            self.order[n] = np.argsort(bucket, kind="stable")
            self.edges[n] = np.searchsorted(bucket[self.order[n]], np.arange((1 << bits) + 1, dtype=np.uint64))

    def training_counts(self) -> dict[int, np.ndarray]:
        used = np.repeat(self.remainders != HELD_OUT, self.lengths)
        return {
            1: np.bincount(self.ids[used], minlength=len(self.words)),
            2: np.bincount(self.pair_of[used], minlength=len(self.pair_word)),
        }

    def totals(self, replies: Iterable[dict], column: str) -> dict[int, np.ndarray]:
        found = {n: np.zeros(len(keys), np.int64) for n, keys in self.keys.items()}
        for reply in replies:
            n, bucket = reply["n"], reply["bucket"]
            found[n][self.order[n][self.edges[n][bucket] : self.edges[n][bucket + 1]]] = _unpack(reply[column])
        return found

    def probabilities(self, totals: dict[int, np.ndarray], tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: the count of its context, pair share and word share."""
        starts = int(totals[1][0])  # as many starts as ends
        contexts = np.r_[totals[1], starts]
        of_context = contexts[self.context]
        pair = totals[2][self.pair_of] / np.maximum(of_context, 1)
        return of_context, pair, totals[1][self.ids] / max(tokens, 1)


def frequency_bucket(contexts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 of its count), up to the last bucket."""
    return np.minimum(np.frexp(contexts.astype(np.float64))[1], FREQUENCY_BUCKETS - 1)


def _count(chunks: DataFrame, bits: int) -> DataFrame:
    """Per chunk, order and bucket: totals of its keys over all training texts, and without the tuning ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                numbered = Numbered(row, bits)
                counts = numbered.training_counts()
                for n, keys in numbered.keys.items():
                    order, edges = numbered.order[n], numbered.edges[n]
                    filled = np.flatnonzero(np.diff(edges)).tolist()
                    parts = [order[edges[b] : edges[b + 1]] for b in filled]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n] * len(filled), pa.int32()),
                            pa.array(filled, pa.int32()),
                            pa.array([row["chunk"]] * len(filled), pa.int64()),
                            pa.array([row["tune"]] * len(filled), pa.bool_()),
                            pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                            pa.array([_pack(counts[n][p]) for p in parts], pa.binary()),
                        ],
                        ["n", "bucket", "chunk", "tune", "keys", "counts"],
                    )

    def add(messages: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in messages["keys"].to_pylist()]
        counts = np.concatenate([_unpack(c) for c in messages["counts"].to_pylist()])
        tune = messages["tune"].to_pylist()
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        others = np.bincount(place, np.where(np.repeat(tune, sizes), 0, counts), len(distinct)).astype(np.int64)
        everything = np.bincount(place, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum(sizes)
        spans = list(zip((ends - sizes).tolist(), ends.tolist()))
        first = [True] + [False] * (len(keys) - 1)
        # The distinct words and the tokens of the bucket go with its first answer only.
        stats = {
            name: [int(value) if lead else 0 for lead in first]
            for name, value in (
                ("seen", (everything > 0).sum()), ("tokens", everything.sum()),
                ("seen_others", (others > 0).sum()), ("tokens_others", others.sum()),
            )
        }
        return pa.table(
            {
                "n": messages["n"], "bucket": messages["bucket"], "chunk": messages["chunk"], "tune": messages["tune"],
                "everything": pa.array([_pack(everything[place[a:b]]) for a, b in spans], pa.binary()),
                "others": pa.array([_pack(others[place[a:b]]) if t else None for (a, b), t in zip(spans, tune)], pa.binary()),
                **{name: pa.array(values, pa.int64()) for name, values in stats.items()},
            }
        )

    return (
        chunks.select("chunk", "tune", "remainders", "lengths", "words", "ids")
        .mapInArrow(send, "n int, bucket int, chunk long, tune boolean, keys binary, counts binary")
        .groupBy("n", "bucket")
        .applyInArrow(
            add,
            "n int, bucket int, chunk long, tune boolean, everything binary, others binary,"
            "seen long, tokens long, seen_others long, tokens_others long",
        )
    )


def _mixture(parts: DataFrame, words: int) -> np.ndarray:
    """Weights (pair, word, uniform) per frequency bucket that make the held-out counts likeliest."""
    weights = np.tile([0.4, 0.4, 0.2], (FREQUENCY_BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    uniform = 1.0 / (words + 1)
    for _ in range(ROUNDS):
        current = weights.copy()

        def expect(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((FREQUENCY_BUCKETS, 3))
            for batch in batches:
                for row in _rows(batch):
                    bucket = np.frombuffer(row["buckets"], np.int8)
                    times = _unpack(row["times"])
                    shares = current[bucket] * np.stack(
                        [np.frombuffer(row["pair"], np.float64), np.frombuffer(row["word"], np.float64), np.full(len(bucket), uniform)], axis=1
                    )
                    shares *= (times / shares.sum(axis=1))[:, None]
                    for k in range(3):
                        sums[:, k] += np.bincount(bucket, shares[:, k], FREQUENCY_BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(FREQUENCY_BUCKETS), pa.int32()), *[pa.array(sums[:, k]) for k in range(3)]], ["bucket", "s2", "s1", "s0"]
            )

        found = parts.mapInArrow(expect, "bucket int, s2 double, s1 double, s0 double")
        for row in found.groupBy("bucket").agg(F.sum("s2"), F.sum("s1"), F.sum("s0")).collect():  # FREQUENCY_BUCKETS rows
            sums = np.array(row[1:]) + 0.5  # so that no weight is zero where there were few tokens
            if row[0] == 0:
                sums[0] = 0.0
            weights[row[0]] = sums / sums.sum()
        if np.abs(weights - current).max() < SETTLED:
            break
    return weights


def score_texts(
    docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Base and model scores of every whole text; ``keep`` columns pass through.

    Adds held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-half unigrams, log10) and score (log10 probability by the interpolated model).
    Texts whose key has remainder HELD_OUT are not learned from. Null and empty texts are just an
    end. Repeated rows are learned from and scored one by one; a null key counts as an empty one.
    An empty table gives an empty result. A kept column with the name of a result gives way to it.
    Words and pairs are told apart by 64-bit hashes. Texts and chunks go to Python in batches bounded by bytes: a chunk
    is some MB, and the default of 64 MB would put many of them in one batch, several times in memory.
    """
    small_batches(docs.sparkSession)
    added = T._parse_datatype_string(RESULTS)
    kept = tuple(name for name in keep if name not in added.names)
    chunks = materialize(number_texts(docs, text, key, kept), "chunks")
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_TOKENS))))
    replies = materialize(_count(chunks, bits), "counts")
    sums = replies.where("n = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("seen", "tokens", "seen_others", "tokens_others")]).first()
    words, tokens, words_others, tokens_others = sums

    def tune(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in _rows(left):
            numbered = Numbered(row, bits)
            contexts, pair, word = numbered.probabilities(numbered.totals(_rows(right), "others"), tokens_others)
            bucket = frequency_bucket(contexts)
            values, of_pair = np.unique(pair, return_inverse=True)
            others, of_word = np.unique(word, return_inverse=True)
            code = (bucket * len(values) + of_pair) * len(others) + of_word
            distinct, times = np.unique(code, return_counts=True)
            rows.append((
                (distinct // len(others) // len(values)).astype(np.int8).tobytes(),
                values[distinct // len(others) % len(values)].tobytes(), others[distinct % len(others)].tobytes(), _pack(times),
            ))
        columns = list(zip(*rows)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in columns], ["buckets", "pair", "word", "times"])

    chunk_columns = ("chunk", "remainders", "lengths", "words", "ids")
    held = chunks.where("tune").select(*chunk_columns).groupBy("chunk")
    answers = replies.where("tune").select(F.col("chunk").alias("of_chunk"), "n", "bucket", "others").groupBy("of_chunk")
    parts = materialize(held.cogroup(answers).applyInArrow(tune, "buckets binary, pair binary, word binary, times binary"), "held-out-counts")
    weights = _mixture(parts, words_others)

    schema = T.StructType([docs.schema[name] for name in kept] + added.fields)
    arrow = to_arrow_schema(schema)
    floor = tokens + 0.5 * (words + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for at, row in enumerate(_rows(left.select(list(chunk_columns)))):
            numbered = Numbered(row, bits)
            totals = numbered.totals(_rows(right), "everything")
            contexts, pair, word = numbered.probabilities(totals, tokens)
            mix = weights[frequency_bucket(contexts)]
            model = np.log10(mix[:, 0] * pair + mix[:, 1] * word + mix[:, 2] / (words + 1))
            of_word = totals[1][numbered.ids]
            base = np.log10((of_word + 0.5) / floor)
            per_text = lambda values: np.add.reduceat(values, numbered.begins)
            made = [
                numbered.remainders == HELD_OUT, numbered.lengths.astype(np.int64), per_text((of_word > 0).astype(np.int64)),
                np.full(len(numbered.lengths), tokens), per_text(base), per_text(model),
            ]
            passed = [left.column(f"keep_{name}").combine_chunks()[at].values for name in kept]
            arrays = passed + [pa.array(m) for m in made]
            tables.append(pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow))
        return pa.concat_tables(tables) if tables else arrow.empty_table()

    everything = replies.select(F.col("chunk").alias("of_chunk"), "n", "bucket", "everything").groupBy("of_chunk")
    texts = chunks.select(*chunk_columns, *[f"keep_{name}" for name in kept]).groupBy("chunk")
    return texts.cogroup(everything).applyInArrow(score, schema)
