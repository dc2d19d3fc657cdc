"""Centroid clustering of integer vectors with a progressive search in the Walsh-Hadamard domain.

The transform H of 64 integers is made of additions alone, and |x - c|^2 = |Hx - Hc|^2 / 64, so
distances add up coefficient by coefficient without rounding. Coefficients stand in order of sequency:
the first ones hold the coarse shape. After a coarse part, the leading centroid of a vector is measured
in full; whatever another centroid has gathered so far is a lower bound of its distance, and a
centroid whose bound is beyond the leader's distance is out. Those that stay are summed through all 64.
Only strictly worse ones go, so ties are decided by number on full distances.

A round is one pass over the transformed vectors, which are written once. A task adds up its
vectors per cluster before the shuffle; sums travel as limbs of 30 bits, so they are exact at any
magnitude and any number of vectors, and the driver sees one row per (cluster, component, limb).

Vectors that are null, of another length, or with a null or non-finite component take no part; an
empty table gives an empty result. Repeated rows count as often as they occur. With fewer vectors
than centroids each starts one. A null key hashes as the empty text. Components beyond
``NARROW`` are computed with unbounded integers; a result beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize

SIZE = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
#: Integer components below this keep 64 squared coefficient differences within a long.
NARROW = 1 << 20
#: Ends of the coefficient ranges, coarse to fine; leaders are measured after the first.
LEVELS = (8, 16, 32, SIZE)
LIMB = 30
LONGEST = (1 << 63) - 1
#: Places of the two totals beside the coefficients of a cluster.
COUNT, INERTIA = SIZE, SIZE + 1

Centroids = list[list[int]]


def _butterfly(values: np.ndarray) -> np.ndarray:
    """The transform in natural order; applied twice it multiplies by 64."""
    half = 1
    while half < SIZE:
        pairs = values.reshape(len(values), -1, 2, half)
        values = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        values = values.reshape(-1, SIZE)
        half *= 2
    return values


def _sequency() -> np.ndarray:
    """Rows of the transform by their number of sign changes."""
    rows = _butterfly(np.eye(SIZE, dtype=np.int64))
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = _sequency()


def transform(values: np.ndarray) -> np.ndarray:
    return _butterfly(values)[:, ORDER]


def restore(coefficients: np.ndarray) -> np.ndarray:
    """The integers whose transform the rows are."""
    return _butterfly(coefficients[:, np.argsort(ORDER)]) // SIZE


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and 64 times the squared distance, from transformed rows."""
    count = len(points)
    partial = np.zeros((count, len(centroids)), points.dtype)
    alive = np.ones((count, len(centroids)), bool)
    rows = np.arange(count)
    start, bound = 0, None
    for stop in LEVELS:
        for number, centroid in enumerate(centroids):
            here = np.flatnonzero(alive[:, number])
            apart = points[here, start:stop] - centroid[start:stop]
            partial[here, number] += (apart * apart).sum(axis=1)
        if bound is None:
            lead = partial.argmin(axis=1)
            apart = points[:, stop:] - centroids[lead, stop:]
            bound = partial[rows, lead] + (apart * apart).sum(axis=1)
        alive &= partial <= bound[:, None]
        start = stop
    beyond = bound.max(initial=0) + 1
    cluster = np.where(alive, partial, beyond).argmin(axis=1)
    return cluster, partial[rows, cluster]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to coefficients: 32-bit where all components are narrow, decimal text elsewhere."""
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        narrow = (np.abs(values) < NARROW / SCALE).all(axis=1)
        scaled = np.floor(np.where(narrow[:, None], values, 0) * SCALE).astype(np.int64)
        packed = [row.tobytes() for row in transform(scaled).astype(np.int32)]
        for at in np.flatnonzero(~narrow):
            # Doubles from 2^53 on are whole, so scaling them as integers loses nothing.
            exact = [int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in values[at]]
            packed[at] = ",".join(map(str, transform(np.array([exact], object))[0])).encode()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), pa.array(narrow)], ["key", "coefficients", "narrow"]
        )


def _unpack(batch: pa.RecordBatch) -> np.ndarray:
    packed, narrow = batch.column("coefficients"), batch.column("narrow").to_numpy(zero_copy_only=False)
    if narrow.all():
        return np.frombuffer(b"".join(packed.to_pylist()), np.int32).reshape(-1, SIZE).astype(np.int64)
    rows = [
        np.frombuffer(data, np.int32).tolist() if fits else [int(x) for x in data.decode().split(",")]
        for data, fits in zip(packed.to_pylist(), narrow)
    ]
    return np.array(rows, object)


def _searcher(centroids: Centroids):
    """A function from a batch of prepared vectors to (coefficients, cluster, 64 x distance)."""
    wide = any(abs(x) >= NARROW for centroid in centroids for x in centroid)

    def search(batch: pa.RecordBatch):
        points = _unpack(batch)
        exact = object if wide or points.dtype == object else np.int64
        points = points.astype(exact)
        return points, *nearest(points, transform(np.array(centroids, exact)))

    return search


def _limbs(value: int) -> list[int]:
    sign, value = (-1 if value < 0 else 1), abs(value)
    parts = []
    while value:
        parts.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return parts


def _totals(prepared: DataFrame, centroids: Centroids) -> dict[int, list[int]]:
    """Per cluster that has vectors: the sums of its coefficients, its count and its inertia."""
    search = _searcher(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), SIZE + 2), object)
        for batch in batches:
            points, cluster, far = search(batch)
            for number in np.unique(cluster):
                here = cluster == number
                sums[number, :SIZE] += points[here].sum(axis=0).astype(object)
                sums[number, COUNT] += int(here.sum())
                sums[number, INERTIA] += sum((far[here] // SIZE).tolist())
        rows = [
            (number, place, limb, part)
            for number, totals in enumerate(sums)
            for place, value in enumerate(totals)
            for limb, part in enumerate(_limbs(int(value)))
        ]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["cluster", "place", "limb", "part"],
        )

    parts = (
        prepared.mapInArrow(add, "cluster int, place int, limb int, part long")
        .groupBy("cluster", "place", "limb")
        .agg(F.sum("part").alias("part"))
    )
    totals: dict[int, list[int]] = defaultdict(lambda: [0] * (SIZE + 2))
    for row in parts.collect():
        totals[row["cluster"]][row["place"]] += row["part"] << (LIMB * row["limb"])
    return totals


def _moved(totals: dict[int, list[int]], centroids: Centroids) -> Centroids:
    """Every centroid that has vectors goes to the floor of their mean."""
    moved = list(centroids)
    for number, sums in totals.items():
        whole = restore(np.array([sums[:SIZE]], object))[0]
        moved[number] = [int(x) // sums[COUNT] for x in whole]
    return moved


def cluster_vectors(
    vectors: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = 3,
) -> DataFrame:
    """Rows (key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one per usable vector.

    Start centroids are the vectors whose ``seed:key`` has the least SHA-256, ties by coefficients.
    """
    kept = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kept = kept.where(F.size("vector") == SIZE).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    kind = kept.schema["key"].dataType.simpleString()
    prepared = materialize(kept.mapInArrow(_prepare, f"key {kind}, coefficients binary, narrow boolean"), "coefficients")

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    first = prepared.orderBy(drawn, "coefficients").limit(centroids).toArrow()
    current: Centroids = []
    if first.num_rows:
        for batch in first.to_batches():
            current += [[int(x) for x in row] for row in restore(_unpack(batch).astype(object))]
    for _ in range(rounds if current else 0):
        current = _moved(_totals(prepared, current), current)
    totals = _totals(prepared, current) if current else {}
    inertia = {number: sums[INERTIA] for number, sums in totals.items()}
    overall = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest() for centroid in current]
    search = _searcher(current)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = lambda value: value if value <= LONGEST else None
        for batch in batches:
            _, cluster, far = search(batch)
            numbers = cluster.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(numbers, pa.int32()),
                    pa.array([fits(x) for x in (far // SIZE).tolist()], pa.int64()),
                    pa.array([fits(inertia[n]) for n in numbers], pa.int64()),
                    pa.array([fits(overall)] * len(numbers), pa.int64()),
                    pa.array([digests[n] for n in numbers], pa.string()),
                ],
                [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return prepared.mapInArrow(
        label,
        f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
    )
