"""Work-item analytics on Spark DataFrames."""
