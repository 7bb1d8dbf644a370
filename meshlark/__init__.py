"""Network-topology analytics on Spark DataFrames."""
