"""Sales and expense analytics on Spark DataFrames."""
