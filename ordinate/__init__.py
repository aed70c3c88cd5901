"""Positional range engine for Spark DataFrames."""
