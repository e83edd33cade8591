"""Operators: each is a function from DataFrames (and parameters) to a DataFrame."""
