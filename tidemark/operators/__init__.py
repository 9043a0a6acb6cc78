"""Operators: pure functions over DataFrames."""
