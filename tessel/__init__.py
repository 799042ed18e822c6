"""Labelled multi-dimensional arrays as Spark DataFrames."""
