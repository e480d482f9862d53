"""Retail data quality and dimensional analytics on Spark DataFrames."""
