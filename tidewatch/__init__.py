"""Monitoring signals from large collections of free-text incident reports, on Spark DataFrames."""
