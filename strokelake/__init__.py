"""Ink and sequence analytics on Spark DataFrames."""
