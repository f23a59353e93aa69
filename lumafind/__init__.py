"""Found-item analytics on Spark DataFrames."""
