"""Operators over DataFrames: each takes frames and column names and returns a frame, lazily."""
