"""Leak detection and training-data preparation on Spark DataFrames."""
