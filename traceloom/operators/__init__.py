"""Operators: DataFrames to DataFrames, lazy, without driver-side loops over rows."""
