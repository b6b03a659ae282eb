"""Similarity-constrained community analytics on Spark DataFrames."""
