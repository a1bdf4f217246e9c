"""Relational building blocks: two DataFrames in, difference DataFrames out."""
