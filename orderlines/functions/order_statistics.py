"""Exact ranks and quantiles of large columns.

An unpartitioned window and an exact ``percentile`` both end in one task that holds everything.
Here the values are range partitioned instead: the partition sizes tell which partitions hold the
wanted positions, and only those are ranked. Equal values are counted before the shuffle, so a
value that fills a third of the table is one row of it.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate
from math import floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a tree of little depth."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


class Ordering:
    """The total order of the rows of ``df`` by ``keys``.

    ``keys`` must tell rows apart, or ``weight`` must hold how often each key occurs.
    """

    def __init__(self, df: DataFrame, keys: list[str], weight: str | None = None):
        copies = F.col(weight) if weight else F.lit(1)
        self._keys = keys
        self._rows = materialize(
            df.select(*keys, copies.cast("long").alias("_copies"))
            .repartitionByRange(*keys)
            .withColumn("_part", F.spark_partition_id()),
            "ordering",
        )
        # One row per shuffle partition.
        sizes = self._rows.groupBy("_part").agg(F.sum("_copies").alias("n")).orderBy("_part").collect()
        self._parts = [row["_part"] for row in sizes]
        self._ends = list(accumulate(row["n"] for row in sizes))
        self.total = self._ends[-1] if self._ends else 0

    def sizes(self, key: str) -> dict:
        """Rows per value of a leading key that has few values."""
        counts = self._rows.groupBy(key).agg(F.sum("_copies").alias("n")).collect()
        return {row[key]: row["n"] for row in counts}

    def ranked(self) -> DataFrame:
        """The key rows with their ``position``, counted from 0; for keys that tell rows apart."""
        spark = self._rows.sparkSession
        starts = [0, *self._ends[:-1]]
        # One row per shuffle partition, so always small.
        offsets = spark.createDataFrame(list(zip(self._parts, starts)), "_part int, _offset long")
        within = Window.partitionBy("_part").orderBy(*self._keys)
        return (
            self._rows.withColumn("_local", F.row_number().over(within) - 1)
            .join(F.broadcast(offsets), "_part")
            .select(*self._keys, (F.col("_offset") + F.col("_local")).alias("position"))
        )

    def at(self, positions: list[int]) -> dict[int, Row]:
        """The key rows at the given positions, counted from 0."""
        wanted = {}
        for position in set(positions):
            index = bisect_right(self._ends, position)
            start = self._ends[index - 1] if index else 0
            wanted[position] = (self._parts[index], position - start)
        if not wanted:
            return {}

        within = Window.partitionBy("_part").orderBy(*self._keys)
        end = F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, 0))
        ranked = (
            self._rows.where(F.col("_part").isin(sorted({part for part, _ in wanted.values()})))
            .withColumn("_end", end)
            .withColumn("_start", F.col("_end") - F.col("_copies"))
        )
        hit = _any(
            [
                (F.col("_part") == part) & (F.col("_start") <= local) & (F.col("_end") > local)
                for part, local in wanted.values()
            ]
        )
        found = ranked.where(hit).collect()
        return {
            position: next(
                row
                for row in found
                if row["_part"] == part and row["_start"] <= local < row["_end"]
            )
            for position, (part, local) in wanted.items()
        }


# Size parameter of the sketches, and the share of all rows by which a bracket reaches beyond what
# they say of its quantile: some four times their usual error.
SKETCH_K = 4_000
MARGIN = 0.001
# Groups in which the sketches of the tasks are merged, before those are merged in turn.
MERGES = 64


def _bracket_ends(
    values: DataFrame, probabilities: dict[str, list[float]]
) -> tuple[dict[str, int], dict[str, list[float]]]:
    """Rows of each column, and per probability the ends of its bracket.

    Sketches are merged in two levels, so that no task takes those of all tasks of a large scan.
    """
    names = list(probabilities)
    groups = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_group")).agg(
        *[F.count(name).alias(f"n_{i}") for i, name in enumerate(names)],
        *[F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(f"s_{i}") for i, name in enumerate(names)],
    )
    merged = groups.agg(
        *[F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"n_{i}") for i in range(len(names))],
        *[
            # A column without values in a group has a sketch of none; it must not be merged.
            F.expr(f"kll_merge_agg_double(s_{i}, {SKETCH_K}) FILTER (WHERE n_{i} > 0)").alias(f"s_{i}")
            for i in range(len(names))
        ],
    )
    wanted = {
        i: [min(max(p + m, 0.0), 1.0) for p in probabilities[name] for m in (-MARGIN, MARGIN)]
        for i, name in enumerate(names)
    }
    row = merged.select(
        *[f"n_{i}" for i in wanted],
        *[
            F.when(F.col(f"n_{i}") > 0, F.kll_sketch_get_quantile_double(f"s_{i}", F.array(*map(F.lit, ranks)))).alias(f"q_{i}")
            for i, ranks in wanted.items()
        ],
    ).first()
    return {name: row[f"n_{i}"] for i, name in enumerate(names)}, {name: row[f"q_{i}"] for i, name in enumerate(names)}


def column_quantiles(
    df: DataFrame, probabilities: dict[str, list[float]]
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several numeric columns.

    Sketches first give a bracket around each quantile. Counting what lies below it and ordering
    only what lies inside, about one row in 500, then gives the exact values, so no column is
    shuffled whole. The counts prove that a bracket holds its quantile; were one to miss, the
    whole column would be ordered. ``df`` is read three times, its columns alone.
    """
    values = df.select(*[F.col(name).cast("double").alias(name) for name in probabilities])
    values = values.select(*[F.nanvl(F.col(name), F.lit(None)).alias(name) for name in probabilities])
    sizes, ends = _bracket_ends(values, probabilities)

    brackets = []
    for name, wanted in probabilities.items():
        size = sizes[name]
        for i, p in enumerate(wanted if size else []):
            place = (size - 1) * p
            low, high = ends[name][2 * i : 2 * i + 2]
            brackets.append(_Bracket(name, p, size, floor(place), place - floor(place), low, high))
    if not brackets:
        return {name: [None] * len(wanted) for name, wanted in probabilities.items()}

    counted = values.agg(
        *[F.count_if(b.below()).alias(f"below_{i}") for i, b in enumerate(brackets)],
        *[F.count_if(b.inside()).alias(f"inside_{i}") for i, b in enumerate(brackets)],
    ).first()
    for i, b in enumerate(brackets):
        b.start = counted[f"below_{i}"]
        if not b.start <= b.position or not b.next_position < b.start + counted[f"inside_{i}"]:
            b.low, b.high, b.start = float("-inf"), float("inf"), 0

    inside = (
        values.where(_any([b.inside() for b in brackets]))
        .select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("bracket"), F.when(b.inside(), F.col(b.name)).alias("value"))
                        for i, b in enumerate(brackets)
                    ]
                )
            )
        )
        .where(F.col("value").isNotNull())
        .groupBy("bracket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ordering = Ordering(inside, ["bracket", "value"], "n")
    sizes, offset = ordering.sizes("bracket"), 0
    for i, b in enumerate(brackets):
        b.offset, offset = offset - b.start, offset + sizes[i]
    rows = ordering.at([b.offset + x for b in brackets for x in (b.position, b.next_position)])
    found = {}
    for b in brackets:
        below = rows[b.offset + b.position]["value"]
        above = rows[b.offset + b.next_position]["value"]
        found[b.name, b.p] = below + (above - below) * b.fraction
    return {name: [found.get((name, p)) for p in wanted] for name, wanted in probabilities.items()}


@dataclass
class _Bracket:
    """Values between ``low`` and ``high``, among which the rows of one quantile are found."""

    name: str
    p: float
    size: int
    position: int
    fraction: float
    low: float
    high: float
    start: int = 0
    offset: int = 0

    @property
    def next_position(self) -> int:
        return min(self.position + 1, self.size - 1)

    def below(self) -> Column:
        return F.col(self.name) < F.lit(self.low)

    def inside(self) -> Column:
        return F.col(self.name).between(F.lit(self.low), F.lit(self.high))
