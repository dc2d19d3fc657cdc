"""Order-line analytics on Spark DataFrames."""

from orderlines.plans.preparation import CleanResult, clean
from orderlines.sources.readers import read_orders, read_typed_orders
from orderlines.sources.writers import write_csv, write_parquet

__all__ = [
    "CleanResult",
    "clean",
    "read_orders",
    "read_typed_orders",
    "write_csv",
    "write_parquet",
]
