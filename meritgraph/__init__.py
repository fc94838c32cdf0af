"""Contribution-graph scoring and reward distribution on Spark DataFrames."""
