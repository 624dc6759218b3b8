"""Readers of network files."""
