"""Compositions of operators: the cleaning chain, the diagnosis and the registered queries."""
