"""Strandloom: sequence analytics on Spark DataFrames."""
