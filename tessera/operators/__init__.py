"""Operators of entity resolution: DataFrames in, DataFrames out."""
