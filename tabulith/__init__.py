"""Columnar result-store analytics on Spark DataFrames."""
