"""Priority-ordered spreader analytics on Spark DataFrames."""
