"""tabulon: evaluation analytics on Spark DataFrames."""
