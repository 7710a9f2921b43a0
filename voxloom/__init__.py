"""Volumetric analytics on Spark DataFrames."""
