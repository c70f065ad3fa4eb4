"""Property-assessment analytics on Spark DataFrames."""
