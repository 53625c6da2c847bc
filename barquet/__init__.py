"""barquet: market-data analytics on Spark DataFrames."""
