"""Entity-attention analytics on Spark DataFrames."""
