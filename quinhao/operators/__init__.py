"""Operators: each takes and returns DataFrames and works on all periods at once."""
