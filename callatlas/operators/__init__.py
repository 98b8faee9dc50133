"""Operators over graph tables: DataFrames in, a DataFrame out."""
