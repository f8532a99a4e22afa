"""Eligibility-catalog analytics on Spark DataFrames."""
