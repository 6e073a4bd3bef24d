"""Failure-log analytics for data pipelines on Spark DataFrames."""
