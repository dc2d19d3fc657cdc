"""How well two groupings of the same rows agree, from their counted cross table alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize

COUNT = "decimal(38,0)"


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows (first, second, n); rows without a label on either side take no part."""
    return (
        df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(F.col(first).alias("first"), F.col(second).alias("second"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _pairs(n: Column) -> Column:
    """Pairs among n rows, exactly."""
    whole = n.cast("decimal(19,0)")
    return (whole * (whole - 1)).cast(COUNT)


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows (measure, value) for two label columns.

    ``rand`` and ``adjusted_rand`` count pairs of rows that both groupings join or part; ``mutual_information`` is in
    nats, ``normalized_information`` divides it by the mean of both entropies; ``homogeneity`` and
    ``completeness`` divide it by the entropy of the first and of the second; ``purity`` is the share of rows
    in the commonest first label of their second, ``inverse_purity`` the other way round; ``cramers_v`` comes from chi
    square. Two groupings of one group each agree fully; an empty table gives no rows.

    The rows are read once. All that follows works on one row per cell, which merge before the shuffle.
    """
    cells = materialize(contingency(df, first, second), "cells")

    def margin(side: str) -> DataFrame:
        return cells.groupBy(side).agg(F.sum("n").alias(f"n_{side}"), F.max("n").alias(f"top_{side}"))

    rows, columns = margin("first"), margin("second")
    of_rows = rows.agg(
        F.sum("n_first").alias("total"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(_pairs(F.col("n_first"))).alias("row_pairs"),
        F.sum("top_first").alias("top_rows"),
        F.sum(F.col("n_first") * F.ln("n_first")).alias("row_logs"),
    )
    of_columns = columns.agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum(_pairs(F.col("n_second"))).alias("column_pairs"),
        F.sum("top_second").alias("top_columns"),
        F.sum(F.col("n_second") * F.ln("n_second")).alias("column_logs"),
    )
    square = F.pow(F.col("n").cast("double"), F.lit(2)) / (F.col("n_first").cast("double") * F.col("n_second").cast("double"))
    of_cells = cells.join(rows, "first").join(columns, "second").agg(
        F.sum(_pairs(F.col("n"))).alias("cell_pairs"),
        F.sum(F.col("n") * F.ln("n")).alias("cell_logs"),
        F.sum(square).alias("squares"),
    )
    # One row each.
    one = of_rows.withColumn("one", F.lit(1)).join(of_columns.withColumn("one", F.lit(1)), "one")
    sums = one.join(of_cells.withColumn("one", F.lit(1)), "one").where("total IS NOT NULL")
    number = lambda name: F.col(name).cast("double")
    pairs, n = _pairs(F.col("total")).cast("double"), number("total")
    expected = F.when(pairs > 0, number("row_pairs") * number("column_pairs") / pairs).otherwise(0.0)
    most = (number("row_pairs") + number("column_pairs")) / 2
    entropy = lambda logs: F.greatest(F.ln(n) - number(logs) / n, F.lit(0.0))
    shared = F.greatest(F.ln(n) + (number("cell_logs") - number("row_logs") - number("column_logs")) / n, F.lit(0.0))
    smaller = F.least("rows", "columns") - 1

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 1e-12, part / whole).otherwise(1.0)

    measures = {
        "rand": F.when(pairs > 0, 1 - (number("row_pairs") + number("column_pairs") - 2 * number("cell_pairs")) / pairs).otherwise(1.0),
        "adjusted_rand": share(number("cell_pairs") - expected, most - expected),
        "mutual_information": shared,
        "normalized_information": share(shared, (entropy("row_logs") + entropy("column_logs")) / 2),
        "homogeneity": share(shared, entropy("row_logs")),
        "completeness": share(shared, entropy("column_logs")),
        "purity": number("top_columns") / n,
        "inverse_purity": number("top_rows") / n,
        "cramers_v": F.when(smaller > 0, F.sqrt(F.greatest(number("squares") - 1, F.lit(0.0)) / smaller)).otherwise(1.0),
    }
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()])))
