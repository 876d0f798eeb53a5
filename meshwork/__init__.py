"""Tabular-to-graph analytics on Spark DataFrames."""
