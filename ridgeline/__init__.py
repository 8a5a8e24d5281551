"""Terrain and record analytics on Spark DataFrames."""
