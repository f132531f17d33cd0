"""Statistical analysis of large tables on Spark DataFrames."""
