"""Catalogue-topology analytics on Spark DataFrames."""
