"""Retail analytics as functions from Spark DataFrames to Spark DataFrames."""
