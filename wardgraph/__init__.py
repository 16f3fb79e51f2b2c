"""Identity attack-path analytics on Spark DataFrames."""
