"""Operators: each takes and returns DataFrames; ``today`` is always a parameter."""
