"""Operators: each takes order lines (or another operator's output) and returns DataFrames."""
