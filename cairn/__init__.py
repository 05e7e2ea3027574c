"""Reachability, set-difference and dedup analytics for content-addressed stores, on Spark DataFrames."""
