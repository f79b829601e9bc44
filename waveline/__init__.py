"""Operators for longitudinal panel data, written for Spark DataFrames."""
