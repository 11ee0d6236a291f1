"""Table quality and pipeline debugging on Spark DataFrames."""
