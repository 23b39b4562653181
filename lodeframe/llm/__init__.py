"""Operators for preparing training data, on plain Spark DataFrames."""
