"""Operators on networks, by family."""
