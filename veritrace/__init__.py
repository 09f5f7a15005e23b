"""Specification analytics on Spark DataFrames."""
