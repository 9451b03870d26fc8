"""Exact, work-avoiding analytics on PySpark DataFrames."""
