"""Exact top-k inner products with block-at-a-time pruning.

Vectors are quantised to integers and kept in blocks of a range of ids: the block's forward index
is its matrix of weights, its summary the least and greatest weight per term. A query's bound for a
block is the sum over the terms of its weight times whichever of the two gives more. Blocks make
shards, queries make groups. A group first searches the shard with its best bound; the scores found
there are thresholds for all others, and a shard in which no bound of the group reaches a threshold
is never sent. Inside a shard each query takes its blocks from the greatest bound down and stops
when the next bound is below its k-th score, so nothing that could enter a result is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize

SCALE = 256
TOP = 5
EVERY = 50
BLOCK_ROWS = 512
SHARD_BLOCKS = 32
GROUP_QUERIES = 256
#: Parts into which the pairing of groups and shards is dealt.
SALTS = 32
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

BLOCK_SCHEMA = (
    "shard long, block long, dim int, ids binary, narrow boolean, weights binary, least array<double>, most array<double>"
)


def _weights(data: bytes, narrow: bool, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if narrow else np.float64).reshape(rows, dim).astype(np.float64)


def _packed(matrix: np.ndarray) -> tuple[bool, bytes]:
    narrow = bool(np.abs(matrix).max(initial=0) < 1 << 15)
    return narrow, matrix.astype(np.int16 if narrow else np.float64).tobytes()


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued doubles; beyond 64 bits they stop at the ends of a long."""
    largest = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if largest < EXACT:
        return (left @ right.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in left], object).reshape(left.shape)
    other = np.array([[int(x) for x in row] for row in right], object).reshape(right.shape)
    return np.clip(exact @ other.T, -LONG - 1, LONG).astype(np.int64)


def bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per query and block the sum of term maxima, rounded up by what floats may have lost."""
    upper = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    size = np.abs(queries) @ np.maximum(np.abs(least), np.abs(most)).T
    return upper + np.where(size < EXACT, 0.0, size * 1e-12)


def threshold(score: int) -> float:
    """A double that is not above the score."""
    value = float(score)
    return value if abs(value) < EXACT else value - abs(value) * 1e-15


def index_blocks(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The block forward indexes of all usable vectors, in ranges of the key.

    Left out are rows with a null key, a null vector or null or non-finite components. Vectors of
    different lengths are in different blocks.
    """
    values = F.col(column).cast("array<double>")
    usable = (
        F.col(key).isNotNull()
        & F.col(column).isNotNull()
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1e305))
    )
    rows = vectors.where(usable).select(
        F.col(key).cast("long").alias("id"),
        F.size(column).alias("dim"),
        values.alias("values"),
    )
    ordered = rows.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        ids, held, dim = [], [], -1

        def block() -> pa.RecordBatch:
            matrix = np.floor(np.concatenate(held).reshape(-1, dim) * SCALE) if dim else np.zeros((sum(map(len, ids)), 0))
            narrow, data = _packed(matrix)
            number = base + count
            row = {
                "shard": base + count // SHARD_BLOCKS, "block": number, "dim": dim, "ids": np.concatenate(ids).tobytes(),
                "narrow": narrow, "weights": data, "least": matrix.min(axis=0).tolist(), "most": matrix.max(axis=0).tolist(),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema(
            [("shard", pa.int64()), ("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("narrow", pa.bool_()),
             ("weights", pa.binary()), ("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))]
        )
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            keys = batch.column("id").to_numpy()
            offsets = batch.column("values").offsets.to_numpy()
            flat = batch.column("values").values.to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                if dims[start] != dim or sum(map(len, ids)) >= BLOCK_ROWS:
                    if ids:
                        yield block()
                        # A shard holds one length only.
                        count += 1 if dims[start] == dim else SHARD_BLOCKS - count % SHARD_BLOCKS
                    ids, held, dim = [], [], int(dims[start])
                room = BLOCK_ROWS - sum(map(len, ids))
                same = int(np.searchsorted(dims[start:], dim, side="right"))
                stop = min(start + room, start + same)
                ids.append(keys[start:stop])
                held.append(flat[offsets[start] : offsets[stop]])
                start = stop
        if ids:
            yield block()

    return ordered.mapInArrow(blocks, BLOCK_SCHEMA)


def _query_groups(blocks: DataFrame, every: int) -> DataFrame:
    """The queries of the blocks of a shard, in groups: ids, blocks and places of the rows, weights."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                matrix = _weights(row["weights"], row["narrow"], row["dim"], len(ids))
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    chosen = {"shard": row["shard"], "dim": row["dim"], "ids": ids[at].tobytes(), "block": row["block"],
                              "places": at.astype(np.int32).tobytes(), "weights": matrix[at].tobytes()}
                    yield pa.RecordBatch.from_pylist([chosen], picked)

    picked = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("block", pa.int64()),
                        ("places", pa.binary()), ("weights", pa.binary())])

    def gather(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in held])
        places = np.concatenate([np.frombuffer(r["places"], np.int32) for r in held])
        of = np.concatenate([np.full(len(r["ids"]) // 8, r["block"], np.int64) for r in held])
        dim = held[0]["dim"]
        matrix = np.concatenate([np.frombuffer(r["weights"], np.float64) for r in held]).reshape(len(ids), dim)
        out = []
        for start in range(0, len(ids), GROUP_QUERIES):
            part = slice(start, start + GROUP_QUERIES)
            out.append({"query_group": held[0]["shard"] * 64 + start // GROUP_QUERIES, "dim": dim, "ids": ids[part].tobytes(),
                        "blocks": of[part].tobytes(), "places": places[part].tobytes(), "queries": matrix[part].tobytes()})
        return pa.Table.from_pylist(out, grouped)

    grouped = pa.schema([("query_group", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("blocks", pa.binary()),
                         ("places", pa.binary()), ("queries", pa.binary())])
    rows = blocks.mapInArrow(pick, "shard long, dim int, ids binary, block long, places binary, weights binary")
    return rows.groupBy("shard").applyInArrow(
        gather, "query_group long, dim int, ids binary, blocks binary, places binary, queries binary"
    )


def search_shard(query: dict, shard: list[dict], kth: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """Rows (query place, vec_id, score) of the best rows of a shard that reach the thresholds."""
    dim = query["dim"]
    ids = np.frombuffer(query["ids"], np.int64)
    of, places = np.frombuffer(query["blocks"], np.int64), np.frombuffer(query["places"], np.int32)
    queries = np.frombuffer(query["queries"], np.float64).reshape(len(ids), dim)
    most = np.array([b["most"] for b in shard], np.float64).reshape(len(shard), dim)
    least = np.array([b["least"] for b in shard], np.float64).reshape(len(shard), dim)
    bound = bounds(queries, least, most)
    order = np.argsort(-bound, axis=1, kind="stable")
    block_ids = [np.frombuffer(b["ids"], np.int64) for b in shard]
    matrices = [None] * len(shard)
    kth = kth.copy()
    best: list[list[tuple[int, int]]] = [[] for _ in ids]
    going = np.ones(len(ids), bool)
    for turn in range(len(shard)):
        chosen = order[:, turn]
        going &= bound[np.arange(len(ids)), chosen] >= kth
        if not going.any():
            break
        for b in np.unique(chosen[going]).tolist():
            if matrices[b] is None:
                matrices[b] = _weights(shard[b]["weights"], shard[b]["narrow"], dim, len(block_ids[b]))
            active = np.flatnonzero(going & (chosen == b))
            scores = inner_products(queries[active], matrices[b])
            reached = scores >= kth[active][:, None]
            reached[of[active] == shard[b]["block"], places[active[of[active] == shard[b]["block"]]]] = False
            for row, q in enumerate(active.tolist()):
                at = np.flatnonzero(reached[row])
                if len(at) > 4 * top:
                    cut = np.partition(scores[row, at], len(at) - top)[len(at) - top]
                    at = at[scores[row, at] >= cut]
                if len(at):
                    found = best[q] + [(-s, i) for s, i in zip(scores[row, at].tolist(), block_ids[b][at].tolist())]
                    best[q] = sorted(found)[:top]
                    if len(best[q]) == top:
                        kth[q] = max(kth[q], threshold(-best[q][-1][0]))
    return [(q, vec_id, -negative) for q, found in enumerate(best) for negative, vec_id in found]


def top_k(
    vectors: DataFrame, top: int = TOP, every: int = EVERY, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``top`` greatest inner products of every query.

    Queries are the rows whose key is divisible by ``every``; candidates all rows but the query's
    own, ties to the smaller key. Components become floor(256 * x). Rows with a null key, and
    vectors that are null or hold null or non-finite components, take no part; vectors meet only
    those of their length. Repeated rows are rows of their own. Fewer candidates give fewer rows, an
    empty table none. Scores beyond 64 bits stop at the ends of a long.
    """
    blocks = materialize(index_blocks(vectors, key, column), "blocks")
    groups = materialize(_query_groups(blocks, every), "query-groups")
    summaries = blocks.select("shard", "dim", F.posexplode(F.arrays_zip("least", "most")).alias("term", "range")).groupBy(
        "shard", "dim", "term"
    ).agg(F.min("range.least").alias("least"), F.max("range.most").alias("most")).groupBy("shard", "dim").agg(
        F.array_sort(F.collect_list(F.struct("term", "least", "most"))).alias("terms")
    )
    shards = blocks.select("shard", "dim").distinct().join(summaries, ["shard", "dim"], "left").select(
        F.col("shard"), "dim",
        F.coalesce("terms.least", F.array().cast("array<double>")).alias("least"),
        F.coalesce("terms.most", F.array().cast("array<double>")).alias("most"),
        F.pmod(F.xxhash64("shard"), F.lit(SALTS)).alias("salt"),
    )
    salted = groups.select("query_group", "dim", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))

    def bound_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"query_group": [], "shard": [], "best": [], "bounds": []}
            for row in batch.to_pylist():
                queries = np.frombuffer(row["queries"], np.float64)
                if row["dim"]:
                    upper = bounds(queries.reshape(-1, row["dim"]), np.array([row["least"]]), np.array([row["most"]]))[:, 0]
                else:
                    upper = np.zeros(GROUP_QUERIES)
                out["query_group"].append(row["query_group"])
                out["shard"].append(row["shard"])
                out["best"].append(float(upper.sum()))
                out["bounds"].append(upper.tolist())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("query_group", pa.int64()), ("shard", pa.int64()), ("best", pa.float64()), ("bounds", pa.list_(pa.float64()))]))

    pairs = materialize(
        salted.join(shards, ["dim", "salt"]).select("query_group", "shard", "dim", "queries", "least", "most").mapInArrow(
            bound_pairs, "query_group long, shard long, best double, bounds array<double>"
        ),
        "pairs",
    )

    def search(chosen: DataFrame, thresholds: DataFrame | None) -> DataFrame:
        left = chosen.select("query_group", "shard").join(blocks.select("shard", "block", "ids", "narrow", "weights", "least", "most"), "shard")
        right = chosen.select("query_group", "shard").join(groups, "query_group")
        if thresholds is None:
            right = right.withColumn("kth", F.array().cast("array<struct<place:int,kth:long>>"))
        else:
            right = right.join(thresholds, "query_group", "left")
        # Names of their own, since both sides come from the same pairs.
        right = right.withColumnsRenamed({"query_group": "of_group", "shard": "of_shard"}).select(
            *[F.col(c).alias(c) for c in ("of_group", "of_shard", "dim", "ids", "blocks", "places", "queries", "kth")]
        )

        def both(query_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
            found = []
            for query in query_rows.to_pylist():
                kth = np.full(len(query["ids"]) // 8, -np.inf)
                for item in query["kth"] or []:
                    kth[item["place"]] = threshold(item["kth"])
                ids = np.frombuffer(query["ids"], np.int64)
                for q, vec_id, score in search_shard(query, block_rows.to_pylist(), kth, top):
                    found.append((query["of_group"], q, int(ids[q]), vec_id, score))
            columns = list(zip(*found)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["query_group", "place", "query_id", "vec_id", "score"]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        return (
            right.groupBy("of_group", "of_shard")
            .cogroup(left.groupBy("query_group", "shard"))
            .applyInArrow(both, "query_group long, place int, query_id long, vec_id long, score long")
        )

    first = pairs.groupBy("query_group").agg(F.max_by("shard", F.struct("best", "shard")).alias("shard"))
    found = materialize(search(first, None), "first-shards")
    kth = (
        found.groupBy("query_group", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        .where(F.col("n") >= top)
        .groupBy("query_group")
        .agg(F.collect_list(F.struct("place", "kth")).alias("kth"))
    )
    # A pair stays if a query without a threshold is in its group or a bound reaches one.
    limits = F.map_from_entries(F.coalesce("kth", F.array().cast("array<struct<place:int,kth:bigint>>")))
    alive = F.exists(
        F.transform("bounds", lambda bound, place: F.coalesce(bound >= F.try_element_at(limits, place), F.lit(True))), lambda x: x
    )
    others = pairs.join(first.withColumn("_first", F.lit(True)), ["query_group", "shard"], "left").where("_first IS NULL")
    rest = others.join(kth, "query_group", "left").where(alive)
    everything = found.unionByName(search(rest, kth))
    order = Window.partitionBy("query_group", "place").orderBy(F.col("score").desc(), "vec_id")
    return (
        everything.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
