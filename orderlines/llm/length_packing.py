"""Packing into length buckets whose boundaries minimise padding.

The lengths of all documents make one histogram, exact up to EXACT and in fine relative steps above,
so its size is bounded whatever the corpus. A dynamic program over it chooses the bucket
boundaries with the least total padding. Inside each bucket batches are filled to a
budget in the unit of the lengths, whitespace words in the registered query and the pipeline:
a batch holds as many documents as fit when all are padded to the bucket's length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 16
BUDGET = 16_384
#: Lengths that are bins of their own; above, a power of two has BINS bins.
EXACT = 4_096
BINS = 256
#: Documents that are ranked in one group.
SLICE = 65_536
SEED = 6
ADDED = ("length", "bucket", "bucket_length", "batch", "slot", "padding")


def _bin(length: Column) -> Column:
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - int(math.log2(BINS)))
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def best_boundaries(count: np.ndarray, total: np.ndarray, longest: np.ndarray, buckets: int) -> list[int]:
    """Ends (exclusive bin positions) of at most ``buckets`` runs of bins with the least padding.

    A run costs its longest length times its documents, less the sum of their lengths.
    """
    n = len(count)
    counts, totals = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(total)]
    best = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        for end in range(1, n + 1):
            cost = best[:end] + longest[end - 1] * (counts[end] - counts[:end]) - (totals[end] - totals[:end])
            choice[end] = np.argmin(cost)
            new[end] = cost[choice[end]]
        choices.append(choice)
        best = new
    ends, end = [], n
    for choice in reversed(choices):
        if end == 0:
            break
        ends.append(end)
        end = int(choice[end])
    return ends[::-1]


def pack(
    docs: DataFrame, length: Column | str, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id"
) -> DataFrame:
    """Adds to every row its length, bucket, bucket_length, batch, slot and padding.

    ``length`` is a column or expression; null counts as 0. ``bucket_length`` is the longest length
    in the bucket, ``batch`` a number unique over all buckets, ``slot`` the place in the batch from
    0, ``padding`` what the row is short of the bucket's length. ``bucket_length`` times the rows of
    a batch is at most ``budget``; a row longer than that is a batch of its own. Repeated rows are
    packed one by one, null keys like others. An empty table gives an empty result. Columns named
    like the added ones are replaced.
    """
    measured = F.coalesce(F.col(length) if isinstance(length, str) else length, F.lit(0)).cast("long")
    rows = docs.withColumn("_length", measured).drop(*ADDED).withColumnRenamed("_length", "length")
    histogram = (
        rows.groupBy(_bin(F.col("length")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum("length").alias("total"), F.max("length").alias("longest"))
        .collect()
    )  # at most EXACT + BINS rows per power of two
    histogram.sort(key=lambda row: row["longest"])
    count, total, longest = (np.array([row[c] for row in histogram], np.float64) for c in ("count", "total", "longest"))
    ends = best_boundaries(count, total, longest, buckets) if histogram else []
    bounds = [int(histogram[end - 1]["longest"]) for end in ends] or [0]
    sizes = [int(count[start:end].sum()) for start, end in zip([0, *ends], ends)] or [0]

    def of_bucket(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])[F.col("bucket")]

    slices = of_bucket([max(1, -(-size // SLICE)) for size in sizes])
    capacity = of_bucket([max(1, budget // max(1, bound)) for bound in bounds])
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("length")))
    chance = F.xxhash64(F.col(key), F.col("length"), F.lit(SEED))
    placed = rows.withColumns({"bucket": bucket, "_chance": chance}).withColumn("_slice", F.pmod("_chance", slices))
    within = placed.groupBy("bucket", "_slice").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = within.select(
        F.col("bucket").alias("_b"), F.col("_slice").alias("_s"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_offset")
    )
    order = Window.partitionBy("bucket", "_slice").orderBy("_chance", F.col(key), "length")
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1)
    joined = ranked.join(offsets, (F.col("bucket") == F.col("_b")) & (F.col("_slice") == F.col("_s")))
    place = F.col("_offset") + F.col("_rank")
    batches = np.cumsum([0] + [-(-size // max(1, budget // max(1, bound))) for size, bound in zip(sizes, bounds)])
    return joined.select(
        *[c for c in rows.columns if c != "length"],
        "length",
        "bucket",
        of_bucket(bounds).alias("bucket_length"),
        (of_bucket(batches[:-1].tolist()) + F.floor(place / capacity)).alias("batch"),
        (place % capacity).cast("int").alias("slot"),
        (of_bucket(bounds) - F.col("length")).alias("padding"),
    )
