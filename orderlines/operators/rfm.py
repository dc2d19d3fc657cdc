"""Customer value: recency, frequency and monetary scores and segments."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from orderlines.functions.expressions import percent, total
from orderlines.functions.order_statistics import Ordering
from orderlines.functions.segments import (
    AT_RISK,
    SHORT_STRATEGIES,
    STRATEGIES,
    segment_of,
    text_for,
)
from orderlines.functions.storage import materialize


def rfm_values(lines: DataFrame, reference: datetime | None = None) -> DataFrame:
    """Whole days since the last order, distinct orders and spend of each customer.

    The reference time is the last order time of all lines plus one day unless given. Customers
    are grouped once and written; their last times give the reference time, and scoring reads
    them again several times, so the lines are read only once.
    """
    customers = materialize(
        lines.groupBy("customer_id").agg(
            F.max("order_time").alias("last_time"),
            F.count_distinct("order_id").alias("frequency"),
            total(F.col("actual_amount")).alias("monetary"),
        ),
        "customers",
    )
    if reference is None:
        until = customers.agg(F.max("last_time") + F.expr("INTERVAL 1 DAY")).scalar()
    else:
        until = F.lit(reference).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.col("last_time"), until)
    return customers.where(F.col("customer_id").isNotNull()).select(
        "customer_id",
        F.floor(micros / F.lit(86_400_000_000)).cast("int").alias("recency"),
        "frequency",
        "monetary",
    )


MEASURES = ["frequency", "monetary", "recency"]


def rfm_scores(values: DataFrame) -> DataFrame:
    """Scores 1 to 3 by terciles, from cut-off rows instead of a window over all customers.

    Recency is cut by value, so equal recency gets an equal score, and small is good. Frequency
    and spend are cut by rank with ties in order of customer id. The three measures are put in
    order together, one after the other.
    """
    measured = values.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("measure"),
                        F.col(name).cast("decimal(28,4)").alias("value"),
                        F.col("customer_id"),
                    )
                    for name in MEASURES
                ]
            )
        )
    ).where(F.col("value").isNotNull())
    ordering = Ordering(measured, ["measure", "value", "customer_id"])
    sizes = ordering.sizes("measure")
    starts = dict(zip(MEASURES, accumulate([0, *[sizes.get(name, 0) for name in MEASURES]])))
    wanted = [starts["recency"] + place for place in _recency_places(sizes.get("recency", 0))]
    for name in ("frequency", "monetary"):
        wanted += [starts[name] + end for end in _rank_ends(sizes.get(name, 0)) if end >= 0]
    rows = ordering.at(wanted)

    def row(name: str, place: int):
        return rows[starts[name] + place]

    edges = _recency_edges(sizes.get("recency", 0), lambda place: int(row("recency", place)["value"]))
    return values.withColumns(
        {
            "R_score": _recency_score(F.col("recency"), edges),
            "F_score": _rank_score("frequency", sizes.get("frequency", 0), row),
            "M_score": _rank_score("monetary", sizes.get("monetary", 0), row),
        }
    )


def _recency_places(n: int) -> list[int]:
    """Positions whose values decide the edges: around each third, within bounds."""
    lows = [(n - 1) * k // 3 for k in (1, 2)]
    return sorted({min(max(low + step, 0), n - 1) for low in lows for step in (-1, 0, 1)}) if n else []


def _recency_edges(n: int, at: Callable[[int], int]) -> list[int]:
    """Thrice the value of the first and second tercile edge, in integers.

    The edge stands at position (n - 1) k / 3 between two values. Where it falls exactly on a row
    that is larger than the one before, that row is above the edge, as in ranking.
    """
    edges = []
    for k in (1, 2) if n else ():
        low, rest = divmod((n - 1) * k, 3)
        here = at(low)
        if rest:
            edges.append(3 * here + rest * (at(low + 1) - here))
        else:
            edges.append(3 * here - int(low > 0 and at(low - 1) < here))
    return edges or [0, 0]


def _recency_score(recency: Column, edges: list[int]) -> Column:
    thrice = recency * 3
    return F.when(thrice <= edges[0], 3).when(thrice <= edges[1], 2).when(recency.isNotNull(), 1)


def _rank_ends(n: int) -> list[int]:
    """Last position of the first and of the second third.

    Position p belongs to the first third when 3p < n - 1, to the second when 3p < 2(n - 1).
    """
    return [-(-(n - 1) * k // 3) - 1 for k in (1, 2)]


def _rank_score(column: str, n: int, row: Callable[[str, int], Row]) -> Column:
    """Tercile of the rank of ``column``, as a comparison with two cut-off rows."""
    score = F.lit(3)
    for points, end in zip((2, 1), reversed(_rank_ends(n))):
        if end >= 0:
            cut = row(column, end)
            value, customer = F.lit(cut["value"]), F.lit(cut["customer_id"])
            upto = (F.col(column) < value) | (
                (F.col(column) == value) & (F.col("customer_id") <= customer)
            )
            score = F.when(upto, points).otherwise(score)
    return score


def rfm_segments(lines: DataFrame, reference: datetime | None = None) -> DataFrame:
    """Values, scores, total score, segment and strategy of every customer."""
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    return (
        rfm_scores(rfm_values(lines, reference))
        .withColumn("RFM_score", r + f + m)
        .withColumn("segment", segment_of(r, f, m))
        .withColumn("strategy", text_for(F.col("segment"), STRATEGIES))
    )


def segment_distribution(segments: DataFrame) -> DataFrame:
    """Customers and share per segment with the short strategy; largest first."""
    counts = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return (
        counts.withColumn("_all", counts.agg(F.sum("customers")).scalar())
        .select(
            "segment",
            "customers",
            percent(F.col("customers"), F.col("_all"), 1).alias("share"),
            text_for(F.col("segment"), SHORT_STRATEGIES).alias("strategy"),
        )
        .orderBy(F.desc("customers"), "segment")
    )


def at_risk_customers(segments: DataFrame) -> DataFrame:
    """Customers of high value who are about to leave."""
    return segments.where(F.col("segment").isin(AT_RISK))
