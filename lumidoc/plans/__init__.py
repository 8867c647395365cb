"""Queries over the input tables, by name."""
