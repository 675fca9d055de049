"""Market-signal analytics on Spark DataFrames."""
