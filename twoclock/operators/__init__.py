"""Operators over claims, each a function from DataFrames to a DataFrame."""
