"""Exact, exhaustive substring search over large text columns on Spark."""
