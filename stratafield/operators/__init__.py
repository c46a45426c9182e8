"""Operators on DataFrames of points and candidates."""
