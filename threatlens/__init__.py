"""Security-log analytics on Spark DataFrames and streams."""
