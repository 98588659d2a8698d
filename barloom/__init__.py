"""Bid/Ask bar analytics on Spark DataFrames."""
