"""The cleaning chain: raw export to analysis-ready lines and a quality report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from orderlines.functions.storage import materialize
from orderlines.operators.cleaning import coerce, deduplicate, fill, normalize_columns, visible
from orderlines.operators.quality import flag_outlier_orders, quality_report, screen_orders


@dataclass
class CleanResult:
    """The lines, and the quality report, whose passes over the lines are made when it is first asked for."""

    lines: DataFrame
    report: Callable[[], DataFrame]

    @cached_property
    def quality(self) -> DataFrame:
        return self.report()


def clean(raw: DataFrame) -> CleanResult:
    """Rename, validate, deduplicate, fill, flag outlying orders and report.

    The filled lines are written once to the shared folder, because the order totals, the report
    and every later operator read them.
    """
    named = normalize_columns(raw)
    if "order_id" not in named.columns:
        raise ValueError("the export has no order id column, so lines cannot be grouped to orders")
    filled = materialize(fill(deduplicate(coerce(named))), "lines")
    lines = visible(filled)
    screen = None
    if "actual_amount" in filled.columns:
        screen = screen_orders(filled)
        lines = flag_outlier_orders(lines, screen)
    return CleanResult(lines, lambda: quality_report(named.columns, filled, screen))
