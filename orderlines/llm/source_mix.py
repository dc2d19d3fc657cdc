"""Mixing sources to target weights: a splitting tree over exact source block quotas.

Each source is cut into blocks by a hash of its documents. A source's target gives its quota: whole
passes over all its blocks, then blocks in hash order, the last one filled with single documents. A
unit is one block in one pass. A binary tree over the output shards splits the units: each node
draws, source by source, how many of its units go left (multivariate hypergeometric), so that every
shard gets an exact number of every source. Each source's units, in hash order, are then dealt to
the shards by those numbers, and a shard is ordered by hash.

Only DataFrame functions are used. All draws are functions of hashes, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize
from orderlines.llm.texts import WORD

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one hash block, over all sources.
BLOCK_DOCUMENTS = 4096
#: Least levels of the splitting tree, which has 2 ** levels shards, and documents of a shard before there are more.
LEVELS = 6
SHARD_DOCUMENTS = 1 << 15
SEED = 20
#: Passes that fill a source's last block with single documents.
FILLS = 4
SIZE, SOURCE_SIZE, TARGET, COPIES, SHARDS = "size", "source_size", "target", "copies", "shards"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Marked units among ``drawn`` of ``total`` units: outcomes are gone through from the most
    likely one upwards, then downwards, until their weights pass ``uniform`` of the sum."""
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    spread = F.sqrt(m * (k / n) * (1 - k / n) * F.greatest(n - m, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0)))
    steps = F.sequence(F.lit(1), (10 * spread + 12).cast("int"))
    mode = F.least(k, m, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double"))

    def up(x: Column) -> Column:
        return (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    def down(x: Column) -> Column:
        return x * (n - k - m + x) / ((k - x + 1) * (m - x + 1))

    def weights(first: Column, ratio: Callable[[Column], Column], sign: int) -> Column:
        def step(state: Column, j: Column) -> Column:
            return _let(
                state["w"] * ratio(first + sign * (j - 1)),
                lambda w: F.struct(w.alias("w"), (state["s"] + w).alias("s")),
            )

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        return F.aggregate(steps, start, step, lambda state: state["s"])

    def walk(first: Column, left: Column, ratio: Callable[[Column], Column], sign: int) -> Column:
        """Steps from ``first`` until the weights have used up ``left``."""

        def step(state: Column, j: Column) -> Column:
            return F.when(state["left"] <= 0, state).otherwise(
                _let(
                    state["w"] * ratio(first + sign * (j - 1)),
                    lambda w: F.when(w <= 0, F.struct(w.alias("w"), F.lit(0.0).alias("left"), state["x"].alias("x")))
                    .otherwise(
                        F.struct(w.alias("w"), (state["left"] - w).alias("left"), (first + sign * j).alias("x"))
                    ),
                )
            )

        start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), first.alias("x"))
        return F.aggregate(steps, start, step, lambda state: state["x"])

    def choose(first: Column, above: Column, below: Column) -> Column:
        left = uniform * (1 + above + below) - 1
        return (
            F.when(left <= 0, first)
            .when(left <= above, walk(first, left, up, 1))
            .otherwise(walk(first, left - above, down, -1))
        )

    drawn_marked = _let(
        F.greatest(mode, k + m - n),
        lambda first: _let(
            F.struct(weights(first, up, 1).alias("above"), weights(first, down, -1).alias("below")),
            lambda sums: choose(first, sums["above"], sums["below"]),
        ),
    )
    return F.when((marked == 0) | (drawn == 0), F.lit(0.0)).otherwise(drawn_marked).cast("long")


def _left_counts(counts: Column, node: Column) -> Column:
    """How many units of each source go to the left child, which takes half of all."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(
        total.alias("total"), (total - F.floor(total / 2)).alias("drawn"), F.array().cast("array<bigint>").alias("out")
    )

    def step(state: Column, item: Column) -> Column:
        draw = _hypergeometric(
            state["total"], item["count"], state["drawn"], _uniform(node, item["place"], F.lit(SEED))
        )
        return _let(
            draw,
            lambda x: F.struct(
                (state["total"] - item["count"]).alias("total"),
                (state["drawn"] - x).alias("drawn"),
                F.array_append(state["out"], x).alias("out"),
            ),
        )

    items = F.transform(counts, lambda c, i: F.struct(c.alias("count"), i.alias("place")))
    return F.aggregate(items, start, step, lambda state: state["out"])


def split_quotas(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (shard, counts) from one row (counts): the exact split of units among 2 ** levels shards."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "counts")
    for _ in range(levels):
        split = nodes.select("node", "counts", _left_counts(F.col("counts"), F.col("node")).alias("left"))
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")),
        )
        nodes = split.select(F.inline(children))
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), "counts")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """Add place (code-point order, null last) and target to rows (source, source_size).

    Targets share the sum of all sizes by weight. A source whose share is above ``cap`` times its
    size stays there and the rest is shared anew: the common level is found by going through the
    sources in the order in which they fill up. One row per source, so the windows are small.
    """
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("place") % len(weights)]
    filling = placed.select(
        "*", weight.alias("weight"), (F.col(SOURCE_SIZE) * float(cap)).alias("most")
    ).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", "place")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum(SOURCE_SIZE).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    leveled = filling.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "place", "level"))).over(everything)
    return leveled.select(
        *sources.columns, "place", F.least("most", F.col("weight") * common["level"]).alias(TARGET)
    )


def _units(blocks: DataFrame, weights: tuple[int, ...], cap: int, levels: int) -> DataFrame:
    """Per block: the shards of its whole passes, and what the source's last block still takes."""
    sources = source_targets(
        blocks.groupBy("source").agg(F.sum("words").alias(SOURCE_SIZE)), weights, cap
    ).withColumn("passes", F.when(F.col(SOURCE_SIZE) > 0, F.floor(F.col(TARGET) / F.col(SOURCE_SIZE))).otherwise(0))
    named = sources.select(F.col("source").alias("_source"), "place", SOURCE_SIZE, TARGET, "passes")
    joined = blocks.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = Window.partitionBy("place").orderBy(F.xxhash64("block", "place", F.lit(SEED)), "block")
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = F.col(TARGET) - F.col("passes") * F.col(SOURCE_SIZE)
    dealt = joined.withColumn("room", F.least(F.col("words").cast("double"), rest - upto + F.col("words")))
    whole = F.col("room") >= F.col("words")
    units = dealt.withColumns(
        {
            "whole": (F.col("passes") + F.when(whole & (F.col("words") > 0), 1).otherwise(0)).cast("int"),
            "room": F.when(whole | (F.col("room") <= 0), 0.0).otherwise(F.col("room")),
        }
    )
    exploded = units.select(
        "*",
        F.explode_outer(
            F.filter(
                F.sequence(F.lit(0), F.col("whole")), lambda i: (i < F.col("whole")) | (F.col("room") > 0)
            )
        ).alias("pass"),
    )
    unit_order = Window.partitionBy("place").orderBy(
        F.col("pass").isNull(), F.xxhash64("block", "place", "pass", F.lit(SEED + 1)), "block", "pass"
    )
    ranked = exploded.withColumn("rank", F.row_number().over(unit_order) - 1)
    quotas = ranked.groupBy("place").agg(F.count("pass").alias("units"))
    counts = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "units"))).alias("all")).select(
        F.col("all.units").alias("counts")
    )
    ends = (
        split_quotas(counts, levels)
        .select("shard", F.posexplode("counts").alias("place", "units"))
        .groupBy("place")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "units"))).alias("quota"))
        .select(
            F.col("place").alias("_place"),
            F.aggregate(
                "quota.units",
                F.array(F.lit(0).cast("long")),
                lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n),
            ).alias("ends"),
        )
    )
    shard = F.size(F.filter(F.col("ends"), lambda end: end <= F.col("rank"))) - 1
    return (
        ranked.join(ends, F.col("place") == F.col("_place"))
        .withColumn("shard", F.when(F.col("pass").isNotNull(), shard))
        .groupBy(F.col("source").alias("_source"), F.col("block").alias("_block"))
        .agg(
            F.first(SOURCE_SIZE).alias(SOURCE_SIZE),
            F.first(TARGET).alias(TARGET),
            F.first("room").alias("_room"),
            F.array_sort(F.collect_list(F.when(F.col("pass") < F.col("whole"), F.col("shard")))).alias("_full"),
            F.max(F.when(F.col("pass") == F.col("whole"), F.col("shard"))).alias("_edge"),
        )
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = MOST_COPIES,
    levels: int | None = None,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """All rows with their share of the mix, under the name of their columns.

    Adds size (words), source_size, target (both of the row's source), copies (0 to ``cap``: how
    often the mix takes the row) and shards (the shard of each copy). ``take`` turns that into the
    mix itself. Sources in code-point order, null last, get ``weights``, repeated; targets share the
    sum of all sizes and stop at ``cap`` times a source's size. A row with the column ``size``
    already set is not counted again. ``levels`` follow the number of rows unless given. Rows without words are never taken. Repeated rows count as
    rows of their own; a null key is a value like any other. An empty table gives an empty result.
    Columns named like the added ones are replaced.
    """
    sized = docs if SIZE in docs.columns else docs.withColumn(SIZE, words_in(F.col(text)))
    sized = sized.drop(SOURCE_SIZE, TARGET, COPIES, SHARDS)
    documents = docs.count()
    block_count = max(1, math.ceil(documents / BLOCK_DOCUMENTS))
    if levels is None:
        levels = max(LEVELS, math.ceil(math.log2(max(1, documents / SHARD_DOCUMENTS))))
    chance = F.xxhash64(F.col(key), F.col(text if text in docs.columns else SIZE), F.lit(SEED))
    keyed = sized.withColumns({"_chance": chance, "_key_block": F.pmod(chance, F.lit(block_count)).cast("int")})
    blocks = keyed.groupBy(F.col(source).alias("source"), F.col("_key_block").alias("block")).agg(
        F.sum(SIZE).alias("words")
    )
    # Few rows per source and block, written so that Spark knows their size when it plans the join.
    units = materialize(_units(blocks, weights, cap, levels), "units")
    planned = keyed.join(
        units, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_key_block") == F.col("_block"))
    )
    inner = planned.where(F.col("_room") == 0).withColumns({SHARDS: F.col("_full")})
    edge = planned.where(F.col("_room") > 0).withColumn("_in", F.lit(False))
    for fill in range(FILLS):
        # The first pass goes in hash order, later ones fill what is left with the largest that fit.
        group = Window.partitionBy("_source", "_block")
        order = [F.col("_chance")] if fill == 0 else [F.col(SIZE).desc(), F.col("_chance")]
        edge = edge.withColumn(
            "_gap", F.col("_room") - F.sum(F.when(F.col("_in"), F.col(SIZE)).otherwise(0)).over(group)
        ).withColumn("_open", ~F.col("_in") & (F.col(SIZE) > 0) & (F.col(SIZE) <= F.col("_gap")))
        upto = F.sum(F.when(F.col("_open"), F.col(SIZE)).otherwise(0)).over(
            group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        edge = edge.withColumn("_upto", upto).withColumn(
            "_in", F.col("_in") | F.col("_open") & (F.col("_upto") <= F.col("_gap"))
        )
    filled = edge.withColumn(
        SHARDS, F.when(F.col("_in"), F.array_append("_full", F.col("_edge"))).otherwise(F.col("_full"))
    )
    columns = [*sized.columns, SOURCE_SIZE, TARGET]
    both = inner.select(*columns, SHARDS).unionByName(filled.select(*columns, SHARDS))
    taken = F.when(F.col(SIZE) > 0, F.col(SHARDS)).otherwise(F.array().cast("array<int>"))
    return both.withColumn(SHARDS, taken).withColumn(COPIES, F.size(SHARDS))


def take(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix: one row per copy with its shard and copy number, shards apart and shuffled inside."""
    copies = mixed.select("*", F.posexplode(SHARDS).alias("copy", "shard")).drop(SHARDS, COPIES)
    order = F.xxhash64(F.col(key), F.col("copy"), F.lit(SEED + 2))
    return copies.withColumn("_order", order).repartition("shard").sortWithinPartitions("shard", "_order").drop("_order")
