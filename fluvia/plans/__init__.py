"""Iteration that no single query plan expresses: closures, pointer doubling, levels, positions."""
