"""Operators from DataFrames to DataFrames. None collects rows on the driver."""
