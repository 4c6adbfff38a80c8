"""Longitudinal risk analytics on Spark DataFrames."""
