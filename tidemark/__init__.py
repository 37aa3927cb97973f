"""Point-in-time analytics on Spark DataFrames."""
