"""Operators for very large media catalogs, on Spark DataFrames."""
