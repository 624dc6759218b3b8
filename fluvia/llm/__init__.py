"""Operators for preparing large text corpora; nothing else in fluvia imports this subpackage."""
