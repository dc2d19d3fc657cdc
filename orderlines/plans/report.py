"""The whole analysis: order lines to the diagnosis table."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlines.functions.storage import marked, settle
from orderlines.operators.basket import mine_rules
from orderlines.operators.diagnosis import SECTIONS, diagnosis
from orderlines.operators.forecasting import forecast, revenue_series
from orderlines.operators.metrics import daily_trend, overview, product_ranking
from orderlines.operators.outliers import isolation_forest
from orderlines.operators.rfm import rfm_segments


def diagnose(
    lines: DataFrame, min_support: float = 0.01, days: int = 14, sections: Collection[str] = SECTIONS, by_order: bool = False
) -> DataFrame:
    """Run every analysis the asked sections need, each written once, and assemble these sections.

    ``lines`` are read by each of them; pass lines that come from a table, as ``clean`` returns. Lines ``by_order`` lie in a
    table of ``write_bucketed``. What an analysis has written on its way is deleted when its result stands.
    """
    spark = lines.sparkSession
    unknown = set(sections) - set(SECTIONS)
    if unknown or not sections:
        raise ValueError(f"sections must be some of {SECTIONS}, not {sorted(sections)}")

    def needed(by: set[str], name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        if not by & set(sections):
            return None
        mark = marked(spark)
        return settle(make(), name, mark)

    found = diagnosis(
        overview=needed({"header", "summary", "volatility", "alerts", "footer"}, "overview", lambda: overview(lines)),
        ranking=needed({"best sellers", "slow movers", "actions"}, "ranking", lambda: product_ranking(lines, by_order)),
        segments=needed({"segments", "actions"}, "segments", lambda: rfm_segments(lines)),
        rules=needed({"rules", "actions"}, "rules", lambda: mine_rules(lines, min_support, by_order=by_order)),
        predicted=needed({"forecast"}, "forecast", lambda: forecast(revenue_series(daily_trend(lines)), days).days),
        orders=isolation_forest(lines) if "alerts" in sections else None,
    )
    return found if set(sections) == set(SECTIONS) else found.where(F.col("section").isin(*sections))
