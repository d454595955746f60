"""Time-series statistics over Spark DataFrames."""
