"""Typed document collections and corpus operators on Spark DataFrames."""
