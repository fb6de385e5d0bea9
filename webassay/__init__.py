"""Site-audit analytics on Spark DataFrames."""
